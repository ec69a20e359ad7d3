"""Kneser-Ney against its definition, and held-out quality."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rootstone.llm import toxicity

SCHEMA = "doc_id long, text string, id string, f0 string, toxic string"
PLAIN = "water house river stone cloud garden window bread paper silver"
BAD = "grumbolt snarvik zlort"


def corpus(n=600):
    draw = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = draw.choice(PLAIN.split(), int(draw.integers(5, 80))).tolist()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(int(draw.integers(2, 4))):
                words.insert(int(draw.integers(0, len(words))), str(draw.choice(BAD.split())).title())
        rows.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    return rows, labels


def grams(words_by_class):
    """(gram, n0, n1) of class-wise word counts, by plain loops."""
    out = defaultdict(lambda: [0, 0])
    for c, words in enumerate(words_by_class):
        for word, n in words.items():
            padded = b"\x02" * 5 + word + b"\x03"
            for i in range(5, len(padded)):
                out[padded[i - 5 : i + 1]][c] += n
    return out


def defined(counts, word):
    """The ratio of a word by the definition, with dictionaries."""
    d = toxicity.DISCOUNT
    shared, below = {}, set(counts)
    for order in range(5, 0, -1):
        ends = Counter(g[1:] for g in below)
        shared[order], below = ends, set(ends)

    def backoff(gram):
        if not gram:
            return 1 / 256
        table = shared[len(gram)]
        following = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        lower = backoff(gram[1:])
        if not following:
            return lower
        return max(table[gram] - d, 0) / sum(following) + d * len(following) / sum(following) * lower

    total = 0.0
    padded = b"\x02" * 5 + word + b"\x03"
    for i in range(5, len(padded)):
        gram, p = padded[i - 5 : i + 1], []
        for c in (0, 1):
            following = [n[c] for g, n in counts.items() if g[:-1] == gram[:-1] and n[c]]
            lower = backoff(gram[1:])
            p.append(max(counts.get(gram, (0, 0))[c] - d, 0) / sum(following) + d * len(following) / sum(following) * lower if following else lower)
        total += math.log(p[1]) - math.log(p[0])
    return total


def test_ratios_are_kneser_ney(spark):
    by_class = ({b"water": 9, b"wander": 4, b"stone": 7, b"a": 2}, {b"water": 3, b"wanker": 2, b"stoned": 1})
    counts = grams(by_class)
    rows = [(int.from_bytes(g, "big"), *n) for g, n in counts.items()]
    model = toxicity.Model(spark.createDataFrame(rows, "gram long, n0 long, n1 long"))
    some = [b"water", b"wanker", b"stones", b"zzz", "ü".encode(), b"a"]
    assert model.ratios(some) == pytest.approx([defined(counts, w) for w in some], abs=1e-3)
    code, n = toxicity.codes(some)
    assert n.tolist() == [len(w) + 1 for w in some] and int(code[0]).to_bytes(6, "big") == b"\x02" * 5 + b"w"


def test_held_out_quality(frame, spark):
    rows, labels = corpus()
    more = [(9000, None), (9001, ""), (9002, " -- "), (None, "water"), (9003, "grumbolt zlort snarvik"), (9004, "water " * 30_000)]
    docs = frame([(*r, "i", "f", "t") for r in rows + more], SCHEMA)
    marks = frame([(*x, "e") for x in labels] + [(5, None, "e"), (None, 1, "e")], "doc_id long, toxic int, text string")
    found = toxicity.score(docs, marks).collect()
    assert len(found) == len(rows + more)
    got = {r.doc_id: r for r in found}
    test = [(got[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    hits = sum(p and t for p, t in test)
    assert len(test) > 100 and hits / sum(t for _, t in test) >= 0.95 and hits / sum(p for p, _ in test) >= 0.95
    assert got[9003].predicted == 1 and got[9004].predicted == 0 and got[9000].score == got[9001].score == got[9002].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    hidden = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    again = toxicity.score(docs, frame([(*x, "e") for x in hidden], "doc_id long, toxic int, text string"))
    assert {r.doc_id: r.score for r in again.collect()} == pytest.approx({r.doc_id: r.score for r in found})


def test_without_labels(frame):
    docs = frame([(1, "water", "i", "f", "t")], SCHEMA)
    for marks in ([], [(1, 1, "e")], [(1, 0, "e"), (2, 0, "e")], [(1, 3, "e"), (2, -1, "e")]):
        assert [(r.score, r.predicted) for r in toxicity.score(docs, frame(marks, "doc_id long, toxic int, text string")).collect()] == [(0.0, 0)]
    assert toxicity.score(frame([], SCHEMA), frame([], "doc_id long, toxic int, text string")).count() == 0


def test_other_labels_are_not_read(frame):
    rows, labels = corpus()
    docs = frame([(*r, "i", "f", "t") for r in rows], SCHEMA)
    score = lambda marks: {r.doc_id: r.score for r in toxicity.score(docs, frame([(*x, "e") for x in marks], "doc_id long, toxic int, text string")).collect()}
    odd = [(rows[0][0], 7), (rows[1][0], -1), (rows[2][0], 2)]
    assert score(labels) == pytest.approx(score(labels + odd))


def test_without_calibration_rows(frame):
    rows, labels = corpus()
    counted = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    found = toxicity.score(frame([(*r, "i", "f", "t") for r in rows], SCHEMA), frame([(*x, "e") for x in counted], "doc_id long, toxic int, text string")).collect()
    got, truth = {r.doc_id: r.score for r in found}, dict(labels)
    toxic, clean = ([got[i] for i in got if truth.get(i) == t] for t in (1, 0))
    assert min(toxic) > max(clean)


def test_large_tables_stay_distributed(frame, monkeypatch):
    rows, labels = corpus(200)
    odd = [(9000, None), (9001, ""), (9002, " -- "), (None, "water"), (None, "water"), (9004, "Water " * 20_000), (9005, "x" * 50_000 + " zlort 漢字"), (7, "snarvik")]
    docs = frame([(*r, "i", "f", "t") for r in rows + odd], SCHEMA)
    marks = frame([(*x, "e") for x in labels], "doc_id long, toxic int, text string")
    scores = lambda: sorted(((r.doc_id or -1, r.score, r.predicted) for r in toxicity.score(docs, marks).collect()))
    collected = scores()
    monkeypatch.setattr(toxicity, "TABLE_BYTES", 0)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 5_000)
    monkeypatch.setattr(toxicity, "Model", None)
    joined = scores()
    assert len(joined) == len(rows + odd)
    for a, b in zip(collected, joined, strict=True):
        assert a[0] == b[0] and a[2] == b[2] and b[1] == pytest.approx(a[1], abs=1e-5)


def test_features():
    assert toxicity.features(np.zeros(0)) == (0.0, 0.0, 0.0)
    assert toxicity.features(np.array([1.0, 5.0])) == (3.0, 3.0, 2.0)
    long = np.zeros(100)
    long[50:52] = 6
    assert toxicity.features(long) == pytest.approx((0.12, 1.0, 4.0))


def test_tables_grow_with_the_counts(spark):
    draw = np.random.default_rng(4)
    code = np.unique(draw.integers(1 << 40, 1 << 48, 2_200_000))  # more than 2^20 and 2^18 of every longer order
    n0 = draw.integers(0, 9, len(code))
    model = toxicity.Model(spark.createDataFrame(toxicity.pa.table({"gram": code, "n0": n0, "n1": 9 - n0})))
    some = draw.integers(0, len(code), 1000)
    assert (model.found(model.long, code[some].astype(np.uint64)) == [n0[some], 9 - n0[some]]).all()
    assert not model.found(model.long, np.setdiff1d(code + 1, code)[:1000].astype(np.uint64)).any()
    contexts, totals = np.unique(code >> 8, return_inverse=True)
    want = [np.bincount(totals, x) for x in (n0, 9 - n0, n0 > 0, n0 < 9)]
    assert (model.found(model.contexts, contexts[:1000].astype(np.uint64)) == [x[:1000] for x in want]).all()
    for order, (counts, _) in model.shared.items():
        below = code if order == 5 else np.unique(code & ((1 << 8 * order + 8) - 1))
        ends, n = np.unique(below & ((1 << 8 * order) - 1), return_counts=True)
        assert (model.found(counts, ends[:1000].astype(np.uint64))[0] == n[:1000]).all()
