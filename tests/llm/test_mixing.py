"""Mixing: targets by definition, pivotal rounding's properties, reruns."""

import re

import numpy as np
import pytest

from rootstone.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, id string, copies string"


def targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(cap * sizes[s]) for s in over}


def corpus():
    draw = np.random.default_rng(6)
    rows = []
    for source, n, most in (("a", 300, 40), ("b", 20, 30), ("Z", 2, 9), ("é", 120, 60), (None, 90, 50), ("c", 700, 20), ("d", 0, 1)):
        rows += [(len(rows) + k, "w " * int(draw.integers(0, most)), source) for k in range(n)]
    return rows + [(5000, None, "a"), (5001, "", "b"), (5002, "  x y", "c"), (5003, None, "empty"), (None, "a b c", "c"), (None, "a b c", "c"), (7, "w " * 11, "a"), (7, "w " * 11, "a")]


def test_targets_and_closeness(frame):
    rows = corpus()
    df = frame([(*r, *"abcd") for r in rows], SCHEMA)
    found = mixing.mix(df).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    sizes = {s: sum(words[i] for i, r in enumerate(rows) if r[2] == s) for s in {r[2] for r in rows}}
    want = targets(sizes)
    assert {r.source: r.source_size for r in found} == sizes and sum(r.m for r in found) == len(rows)
    assert {r.source: r.target for r in found} == pytest.approx(want)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size * r.m
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 12), s
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    other = mixing.mix(df, seed=2).collect()
    assert {(r.id, r.size): r.copies for r in found} != {(r.id, r.size): r.copies for r in other}


def test_tree_of_groups(frame, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 16)
    df = frame([(i, "w " * (1 + i % 37), "ab"[i % 3 == 0], *"abcd") for i in range(900)], SCHEMA)
    found = mixing.mix(df).collect()
    for source in "ab":
        own = [r for r in found if r.source == source]
        expected = own[0].target / own[0].source_size * len(own)
        assert abs(sum(r.copies for r in own) - expected) <= 1
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.02 * own[0].target


def test_the_mix_itself(frame):
    df = frame([(*r, *"abcd") for r in corpus()], SCHEMA)
    decided = {(r.id, r.source, r.size): r.copies * r.m for r in mixing.mix(df).collect() if r.copies}
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    counts = {}
    for r in mixed.collect():
        k = (r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
        counts[k] = counts.get(k, 0) + 1
    assert counts == decided
    assert mixing.mix(frame([], SCHEMA)).count() == 0 and mixing.mixed(frame([], SCHEMA)).count() == 0
    assert [r.copies * r.size for r in mixing.mix(frame([(1, None, "a", *"abcd"), (2, "", None, *"abcd")], SCHEMA)).collect()] == [0, 0]


def test_pivot_keeps_sums_and_probabilities():
    draw = np.random.default_rng(1)
    for _ in range(200):
        p = draw.random(int(draw.integers(1, 30)))
        out = mixing.pivot(p, draw.random(len(p)))
        assert out.sum() == pytest.approx(p.sum()) and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
    p = np.array([0.3, 0.8, 0.4, 0.5])
    mean = np.mean([mixing.pivot(p, draw.random(4)) for _ in range(20_000)], axis=0)
    assert mean == pytest.approx(p, abs=0.02)


def test_documents_are_taken_with_their_probabilities(spark):
    """Through the whole operator: very unlike sizes in one small group do not change how often each is taken."""
    sizes, n = (10, 1, 1), 1500
    rows = [(k * n + g, "w " * size, f"s{g}") for g in range(n) for k, size in enumerate(sizes)]
    taken = dict.fromkeys(range(3), 0.0)
    wanted = dict.fromkeys(range(3), 0.0)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r.id // n] += r.copies
        wanted[r.id // n] += r.target / r.source_size
    for k in range(3):
        assert abs(taken[k] - wanted[k]) < 5 * (0.25 * n) ** 0.5, (k, taken, wanted)


def test_clashing_columns(frame):
    names = ["id", "size", "copies", "_copy", "_n", "one", "row"]
    df = frame([(i, "a b c", "s", *[f"{n}{i}" for n in names]) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    found = mixing.mixed(df)
    assert found.columns == df.columns and all(r[n] == f"{n}{r.doc_id}" for r in found.collect() for n in names)
