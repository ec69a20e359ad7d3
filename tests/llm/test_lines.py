"""Line deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from rootstone.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, t string, id string, pos string, h string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UP)


def brute(rows, least, first):
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    seen, out = set(), []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = []
        for line in split:
            k = key(line)
            gone = k and len(where[k]) >= least
            if gone and first and k not in seen:
                seen.add(k)
                gone = False
            if not gone:
                kept.append(line)
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return out


def corpus():
    draw = random.Random(8)
    some = ["The Same line", " the same LINE\t", "ÄB", "äb", "KK", "Kk", "kk", "", "  ", "rare", "x" * 3000, "é a", " x", "x"]
    rows = [(i, "\n".join(draw.choice(some) for _ in range(draw.randint(0, 70)))) for i in range(40)]
    return rows + [(40, None), (41, ""), (42, "\n\n"), (43, "only here\r\nThe same line\r"), (44, "\n".join(f"own {i}" for i in range(300)) + "\nrare")]


@pytest.mark.parametrize(("least", "hot"), [(10, 20_000), (2, 20_000), (10, 30), (3, 5)])
@pytest.mark.parametrize("first", [False, True])
def test_against_brute_force(frame, monkeypatch, least, hot, first):
    monkeypatch.setattr(lines, "HOT_ROWS", hot)
    rows = corpus()
    found = lines.drop_repeated(frame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA), min_docs=least, first=first).collect()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in found}
    want = {i: tuple(rest) for i, *rest in brute(rows, least, first)}
    if first:  # which occurrence is first within equal ids is by text hash; ids differ here, so order is by id
        assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    assert got == want


def test_shape(frame):
    df = frame([(1, "a\nb", "keep", "t", "i", "p", "h"), (None, "a", "k", "t", "i", "p", "h"), (None, "a", "k", "t", "i", "p", "h"), (1, "a\nb", "keep", "t", "i", "p", "h")], SCHEMA)
    plain = lines.drop_repeated(df, min_docs=2, counts=False)
    assert plain.columns == df.columns and plain.schema == df.schema
    got = sorted((r.doc_id or 0, r.text, r.n_lines) for r in plain.collect())
    assert got == [(0, "", "k"), (0, "", "k"), (1, "b", "keep"), (1, "b", "keep")]  # null ids are one document, as are equal ids
    assert lines.drop_repeated(frame([], SCHEMA)).count() == 0


def test_bitmaps(frame):
    marks = lines.line_bitmaps(frame([(i, "\n".join(["hot"] + [f"{i} {k}" for k in range(70)] + ["hot"]), *"abcde") for i in range(12)], SCHEMA)).collect()
    assert len(marks) == 12 and all(r.n_dropped == 2 and dict(r.bitmap) == {0: 1, 2: 1 << 7} for r in marks)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("hot", [1, 1000])  # the shared line is hot, cool
@pytest.mark.parametrize("ids", [[None, None, 7], [3, 3, 7]])
def test_first_occurrence_in_repeated_rows_stays(frame, monkeypatch, hot, ids):
    monkeypatch.setattr(lines, "HOT_ROWS", hot)
    rows = [(ids[0], "shared\nmine"), (ids[1], "shared\nmine"), (ids[2], "Shared\nother"), *[(100 + i, f"shared\n{i}") for i in range(12)]]
    found = lines.drop_repeated(frame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA), min_docs=3, first=True).collect()
    kept = [(r.doc_id, r.text) for r in found if "shared" in r.text.lower().split("\n")]
    least = min(((i is not None, i or 0) for i in ids))  # nulls sort first
    assert {(i is not None, i or 0) for i, _ in kept} == {least} and len({t for _, t in kept}) == 1  # one text's occurrence
    assert len(kept) == rows.count((kept[0][0], kept[0][1])) and sum(r.n_dropped for r in found) == len(rows) - len(kept)


def test_clashing_columns(frame):
    names = ["id", "t", "n_dropped", "bitmap", "_mark_n", "_mark_bits", "row", "keys"]
    df = frame([(i, "same\nown", *[f"{n}{i}" for n in names]) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = lines.drop_repeated(df, min_docs=3, counts=False).collect()
    assert len(found) == 4 and all(r.text == "" and all(r[n] == f"{n}{r.doc_id}" for n in names) for r in found)
    counted = lines.drop_repeated(df, min_docs=3).collect()
    assert {(r.n_lines, r.n_dropped) for r in counted} == {(2, 2)} and all(r.bitmap == f"bitmap{r.doc_id}" for r in counted)
