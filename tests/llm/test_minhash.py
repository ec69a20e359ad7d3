"""Near-duplicates against brute force: planted copies, chains, hot groups, nulls, repeated ids, clashing columns."""

import random

import numpy as np
import pytest

from rootstone.llm import minhash
from rootstone.llm.common import linked, lowered, word_hashes
from rootstone.llm.components import components

SCHEMA = "doc_id long, text string, n_shingles string, id string, component_id string, kept string"


def shingles(text, width):
    words = lowered(text).split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y)]
    return roots({i for i, _ in rows if i is not None}, links)


def planted():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (1, 1, 1, 2, 3, 5, 12, 40):
        base = [word() for _ in range(draw.randint(30, 90))]
        for k in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, 5) if k else 0):
                copy[draw.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    for _ in range(12):  # neighbours are alike, the ends are not
        rows.append("\n".join(chain))
        at = draw.randrange(50)
        chain = chain[:at] + [word(), word()] + chain[at + 2 :]
    rows += ["Same Text here", "same  text\there ", "SAME TEXT HERE", "one", "one", "Ärger one", "ärger one", "", None, " \n", None, "x " * 5000 + "tail"]
    order = list(range(len(rows)))
    draw.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("width", "blocks"), [(2, (4096, 512)), (5, (8, 7)), (1, (4096, 512))])
def test_against_brute_force(frame, width, blocks):
    rows = planted()
    df = frame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)
    found = minhash.near_duplicates(df, width=width, bucket_block=blocks[0], family_block=blocks[1]).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, width)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t, width)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_nulls_repeats_and_nothing(frame):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (1, "a b c d e f g"), (3, "p q r s t u v"), (7, "p q r s t u v"), (9, None)]
    found = minhash.near_duplicates(frame([(*r, "", "", "", "") for r in rows], SCHEMA)).collect()
    assert len(found) == 7
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(None, None, True), (3, 1, False), (1, 1, True), (7, 1, False), (9, 9, True)}
    assert minhash.near_duplicates(frame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("agreement", [0.6, 0.0])
def test_large_families(frame, monkeypatch, agreement):
    """Families over many blocks, by rows and by bytes: copies of a leader, members that only others link, and chains."""
    monkeypatch.setattr(minhash, "FAMILY_BYTES", 3000)
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(60)], []
    for k in range(70):
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(60)] = word()
        rows.append((1000 - 7 * k, " ".join(copy)))
        if k % 10 == 0:
            base = copy
    found = minhash.near_duplicates(frame([(*r, "", "", "", "") for r in rows], SCHEMA), width=2, family_block=6, agreement=agreement).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, 2)


def test_every_text_of_an_id_counts(frame):
    """Near, not equal, links of each text of an id that has several."""
    text = lambda c, last: " ".join(f"{c}{i}" for i in range(40)) + " " + last
    rows = [(5, text("a", "x")), (5, text("b", "x")), (5, text("c", "x")), (9, text("a", "y")), (8, text("b", "y")), (7, text("c", "y")), (3, text("d", "z"))]
    found = minhash.near_duplicates(frame([(*r, "", "", "", "") for r in rows], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 5), (9, 5), (8, 5), (7, 5), (3, 3)}


def test_word_hashes_tell_words_apart():
    texts = [b"", b"a", b" a  b\tc\x0bd ", "é ü x".encode(), b"x" * 100_000, b"ab ba aab aba"]
    hashes, counts = word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))


def test_linked_finds_every_component():
    draw = np.random.default_rng(3)
    for _ in range(60):
        n = int(draw.integers(1, 25))
        near = draw.random((n, n)) < draw.choice([0.02, 0.1, 0.4])
        near |= near.T
        want = roots(range(n), list(zip(*np.nonzero(near), strict=True)))
        assert linked(n, lambda i, others: near[i, others]).root.tolist() == [want[i] for i in range(n)]


def test_components(frame):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3), (101, 100)]
    found = components(frame(edges, "u long, v long")).collect()
    pairs = [(a, b) for a, b in edges if a is not None and a != b]
    want = roots({x for e in pairs for x in e}, pairs)
    assert {r.id: r.component for r in found} == want and len(found) == len(want)
    assert components(frame([], "u long, v long")).count() == 0


def test_hot_keys_are_joined_whole(frame):
    from rootstone.llm.common import join_counted

    rows = frame([(k % 7 if k % 2 else 3, k) for k in range(4000)] + [(k, k) for k in range(100, 2600)], "u long, v long")
    lookup = rows.groupBy("u").count().withColumnRenamed("count", "n")
    found = join_counted(rows, lookup, ["u"], "n", rows.count())
    assert found.count() == 6500 and found.distinct().count() == 6500 and found.groupBy("u").count().join(lookup, "u").where("count <> n").count() == 0
