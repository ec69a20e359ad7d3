"""Embedding near-duplicates against brute force."""

import numpy as np

from rootstone.llm import embeddings
from rootstone.llm.common import Sets
from test_minhash import roots

SCHEMA = "vec_id long, embedding array<double>, x string, id string, n string"


def vectors():
    draw = np.random.default_rng(4)
    out = []
    for size in (1, 1, 4, 60, 9):
        base = draw.normal(size=10)
        out += [(base + draw.normal(size=10) * 0.12 * np.linalg.norm(base) / 3).tolist() for _ in range(size)]
    out += [out[5]] * 30 + [(np.array(out[5]) * 3).tolist()]
    steps = np.linspace(0, 3, 20)
    out += [[float(np.cos(a)), float(np.sin(a)), *[0.0] * 8] for a in steps]
    bad = [None, [0.0] * 10, [float("nan")] * 10, [float("inf"), *[1.0] * 9], [None, *[1.0] * 9], []]
    return out + bad + [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [1e200, 1e200], [1e-200, 1e-200]]


def brute(rows, cosine=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    return links, roots([i for i, _ in rows], links)


def check(frame, rows, **more):
    found = embeddings.near_duplicates(frame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA), **more).collect()
    links, root = brute(rows)
    assert len(found) == len(rows)
    assert {r.vec_id: r.component_id for r in found} == root
    assert {r.vec_id: r.n_links for r in found} == {i: sum(i in e for e in links) for i, _ in rows}
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_against_brute_force(frame):
    order = np.random.default_rng(1).permutation(len(vectors())).tolist()
    rows = [(i, vectors()[k]) for i, k in enumerate(order)]
    check(frame, rows)
    check(frame, rows, block=16)


def test_nulls_repeats_and_nothing(frame):
    rows = [(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.01]), (5, None)]
    found = embeddings.near_duplicates(frame([(*r, "", "", "") for r in rows], SCHEMA)).collect()
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found)
    assert got == [(0, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (5, 0, 5)]
    assert embeddings.near_duplicates(frame([], SCHEMA)).count() == 0


def many(n=900):
    """Vectors around some centres, and some copies of them."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(25, 12))
    x = centres[draw.integers(0, 25, n)] + 0.25 * draw.normal(size=(n, 12))
    x[::9] = x[1::9] + 0.02 * draw.normal(size=x[::9].shape)
    return x


def test_many_lists_lose_nothing(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_ROWS", 40)
    check(frame, list(enumerate(many().tolist())))


def test_few_probes_still_find_most(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_ROWS", 40)
    rows = list(enumerate(many().tolist()))
    found = embeddings.near_duplicates(frame([(*r, "", "", "") for r in rows], SCHEMA), probes=3).collect()
    links, _ = brute(rows)
    assert 0.9 * 2 * len(links) <= sum(r.n_links for r in found) <= 2 * len(links) and len(links) > 300


def test_probes_and_codes_lose_nothing(monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_ROWS", 40)
    x = many(800)
    index = embeddings.Index(x, 800)
    assert len(index.centres) == 20
    unit = index.unit(x)
    reach = 0.6
    own, rows, lists = index.probes(unit, reach)
    codes, errors = index.code(unit, own)
    near = np.sqrt(((unit[:, None] - unit[None]) ** 2).sum(axis=2)) <= reach
    visits = set(zip(rows.tolist(), lists.tolist(), strict=True))
    assert len(visits) > 100
    crossing = 0
    for i, j in zip(*np.nonzero(near), strict=True):
        if own[i] < own[j]:
            assert (i, own[j]) in visits
            crossing += 1
    assert crossing > 10
    for k in range(len(index.centres)):
        members = np.flatnonzero(own == k)
        if len(members):
            d = np.sqrt(index.distances(unit, k, codes[members]))
            exact = np.sqrt(((unit[:, None] - unit[None, members]) ** 2).sum(axis=2))
            assert (np.abs(d - exact) <= errors[members][None] + 1e-6).all()


def test_only_codes_and_candidates_are_dealt_out(frame, monkeypatch):
    """Vectors without clusters, and a few groups of near copies: no link is lost, and only vectors with a candidate meet as vectors."""
    dealt, real = [], embeddings._dealt
    monkeypatch.setattr(embeddings, "_dealt", lambda rows, *more: dealt.append(rows) or real(rows, *more))
    draw = np.random.default_rng(9)
    x = draw.normal(size=(1200, 64))
    for at, size, spread in ((0, 300, 0.2), (600, 40, 0.3), (700, 9, 0.2), (710, 2, 0.1)):
        x[at : at + size] = x[at] + spread * draw.normal(size=(size, 64))
    check(frame, list(enumerate(x[draw.permutation(len(x))].tolist())), block=250)
    assert sum(rows.count() for rows in dealt if "x" in rows.columns) <= 300 + 40 + 9 + 2


def test_codes_of_leading_dimensions_lose_nothing():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1500, 64))
    x[500:] = x[:500].repeat(2, axis=0) + draw.normal(size=(1000, 64)) * draw.uniform(0.1, 0.5, 1000)[:, None]
    index, reach = embeddings.Index(x, 1500), 0.3162278
    unit = index.unit(x)
    own = index.own(unit)
    codes, errors = index.code(unit, own)
    back, exact = index.decoded(own, codes), np.sqrt(((unit[:, None] - unit[None]) ** 2).sum(axis=2))
    assert 8 <= index.head(unit, reach) < 64 and (exact <= reach).sum() > 2000
    for head in (2, 8, 24, 64):
        left, right = embeddings._sides(back[:, :head], index.errors(unit, own, codes, head), reach)
        remain = left @ right.T >= 0
        assert remain[exact <= reach].all()
        if head >= 24:
            assert remain[exact > 1].mean() < 0.001


def test_sets_merge_like_joins():
    draw = np.random.default_rng(5)
    for edges in (1, 40, 90, 400):
        i, j = draw.integers(0, 100, edges), draw.integers(0, 100, edges)
        one, other = Sets(100), Sets(100)
        one.merge(i, j)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            other.join(a, np.array([b]))
        assert one.root.tolist() == other.root.tolist()
