"""Exact top-k against brute force: ties, hot copies, bad vectors, several lengths."""

import math

import numpy as np
import pytest

from rootstone.llm import topk

SCHEMA = "vec_id long, embedding array<double>, id string, x string, q string"


def vectors():
    draw = np.random.default_rng(3)
    out = [draw.normal(size=6).tolist() for _ in range(150)]
    out += [out[3]] * 120 + [[0.01] * 6] * 30
    out += [None, [float("nan")] * 6, [float("inf")] * 6, [None] * 6, [0.0] * 6, [1.0, 2.0], [2.0, 1.0], [3.0, 3.0], []]
    return [(i, v) for i, v in enumerate(out)]


def brute(rows, k, every, scale):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize(("k", "every", "bins", "block"), [(20, 20, 512, 8 << 20), (7, 9, 4, 2000), (500, 50, 16, 1), (1, 1, 512, 8 << 20)])
def test_against_brute_force(frame, monkeypatch, k, every, bins, block):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    rows = vectors() if every > 1 else vectors()[:60]
    found = topk.top_k(frame([(i, v, *"abc") for i, v in rows], SCHEMA), k=k, every=every).collect()
    assert {tuple(r) for r in found} == brute(rows, k, every, 64) and len(found) == len({(r.query_id, r.rank) for r in found})


def test_edges(frame):
    assert topk.top_k(frame([], SCHEMA)).count() == 0
    alone = topk.top_k(frame([(0, [1.0], *"abc"), (None, [1.0], *"abc")], SCHEMA))
    assert alone.count() == 0 and dict(alone.dtypes)["rank"] == "int"
    with pytest.raises(Exception, match="2\\^53"):
        topk.top_k(frame([(0, [1e12], *"abc"), (1, [1e12], *"abc")], SCHEMA)).collect()


def test_a_worker_holds_little():
    """The peak of one histogram pass with a full block of queries over many rows."""
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(1)
    n, dim = topk.BLOCK_QUERIES, 16
    q = np.floor(64 * draw.normal(size=(n, dim)))
    rows = pa.array(np.floor(64 * draw.normal(size=(3000, dim))).astype(np.int64).tolist(), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000) + n), rows], ["id", "x"])

    class Block:
        value = (np.arange(n), q)

    high = np.full(n, 1e6)
    tracemalloc.start()
    for out in topk._histogram(Block, -high, high, np.full(n, 4000.0), np.full(n, 20))(iter([batch])):
        assert len(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
