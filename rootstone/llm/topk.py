"""Exact top-k by histogram selection: score everything, refine histograms until the kth value of each query is known, then
filter and break ties by id.

Queries come in blocks of bounded bytes, which are broadcast; each pass over the vectors scores a block of them with a matrix
product and sends only histogram cells. A partition sends a query's cells down to its own kth score, as the global
kth cannot lie below. Ranges shrink BINS-fold a pass until every query's kth score is one value. The last pass sends what is
above that value, and of ties with it the least ids, as many as can be needed.

Semantics. Components become floor(scale * x) with x as double; scores are integer inner products. Vectors that are null, or
hold null or non-finite components, take no part, neither do null ids. Queries are ids divisible by `every`; a query's
candidates are all rows of other ids that have as many components. Ties go to the smaller id; rows that repeat an id are
candidates each, and one query per row. Fewer than k candidates: all of them. Products must stay below 2^53, else an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, staged

#: Bytes and queries of a broadcast block at most, scores of one matrix product (8 bytes each, a handful of such arrays at a time), cells of a
#: query's histogram. With 4,096 queries a worker holds 17 MB of scores and 17 MB of cells, a few times over.
BLOCK_BYTES, BLOCK_QUERIES, SCORES, BINS = 8 << 20, 4096, 2 << 20, 512
EXACT = float(1 << 53)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    x = F.col("x")
    good = x.isNotNull() & F.col("id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("x")).where(good).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of the vectors of dim components."""
    column = batch.column(batch.schema.get_field_index("x"))
    ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return ids, flat.reshape(len(ids), dim)
    keep = lengths == dim
    return ids[keep], flat[np.repeat(keep, lengths)].reshape(keep.sum(), dim)


def _scores(batches: Iterator[pa.RecordBatch], q_ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores, valid): scores of some rows by all queries; a query's own row isn't valid."""
    most = np.abs(q).sum(axis=1).max(initial=0)
    for batch in batches:
        ids, rows = _matrix(batch, q.shape[1])
        if len(rows) and most * np.abs(rows).max(initial=0) >= EXACT:
            raise ValueError("an inner product may pass 2^53; use a smaller scale")
        step = max(1, SCORES // max(1, len(q)))
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            yield some, q @ rows[at : at + step].T, some[None, :] != q_ids[:, None]


def _extent(block):
    """Least and largest score of each query in this partition, and its number of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = block.value
        low, high, n = np.full(len(q), np.inf), np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
        for _, s, valid in _scores(batches, q_ids, q):
            low = np.minimum(low, np.where(valid, s, np.inf).min(axis=1, initial=np.inf))
            high = np.maximum(high, np.where(valid, s, -np.inf).max(axis=1, initial=-np.inf))
            n += valid.sum(axis=1)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(low[there].astype(np.int64)), pa.array(high[there].astype(np.int64)), pa.array(n[there])], ["q", "low", "high", "n"])

    return run


def _histogram(block, low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray):
    """Counts of scores from low to high by cell; scores above the range are known to be in, those below out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = block.value
        cells = np.zeros((len(q), BINS), np.int64)
        for _, s, valid in _scores(batches, q_ids, q):
            cell = np.floor_divide(s - low[:, None], width[:, None])
            rows, columns = np.nonzero(valid & (cell >= 0) & (s <= high[:, None]))
            cells += np.bincount(rows * BINS + cell[rows, columns].astype(np.int64), minlength=cells.size).reshape(cells.shape)
        above = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1] - cells  # of higher cells
        rows, columns = np.nonzero((cells > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(columns), pa.array(cells[rows, columns])], ["q", "cell", "n"])

    return run


def _chosen(block, kth: np.ndarray, ties: np.ndarray):
    """Rows above the kth score, and of rows with that score the least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = block.value
        tied = [np.zeros(0, np.int64)] * len(q)
        for ids, s, valid in _scores(batches, q_ids, q):
            rows, columns = np.nonzero(valid & (s > kth[:, None]))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(rows), pa.array(ids[columns]), pa.array(s[rows, columns].astype(np.int64))], ["query_id", "q", "vec_id", "score"])
            rows, columns = np.nonzero(valid & (s == kth[:, None]))
            for i in np.unique(rows).tolist():
                both = np.sort(np.concatenate([tied[i], ids[columns[rows == i]]]))
                tied[i] = both[: ties[i]]
        n = np.array([len(x) for x in tied])
        rows = np.repeat(np.arange(len(q)), n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_ids[rows]), pa.array(rows), pa.array(np.concatenate(tied) if len(tied) else np.zeros(0, np.int64)), pa.array(kth[rows].astype(np.int64))],
            ["query_id", "q", "vec_id", "score"],
        )

    return run


def _select(vectors: DataFrame, block, n_queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The kth score of each query of a block, and how many ties with it belong to the result."""
    rows = vectors.mapInArrow(_extent(block), "q long, low long, high long, n long").groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n")).collect()
    low, high, count = np.zeros(n_queries), np.zeros(n_queries), np.zeros(n_queries, np.int64)
    for q, a, b, n in rows:
        low[q], high[q], count[q] = a, b, n
    need = np.minimum(k, count)  # still to be found within [low, high]
    while (high > low).any():
        width = np.maximum(1, np.ceil((high - low + 1) / BINS))
        cells = vectors.mapInArrow(_histogram(block, low, high, width, need), "q long, cell long, n long").groupBy("q", "cell").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("cell"))) - F.col("n")
        wanted = vectors.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "q long, need long")
        hit = cells.withColumn("above", above).join(F.broadcast(wanted), "q").where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        for q, cell, over in hit.select("q", "cell", "above").collect():  # one row per query of the block
            need[q] -= over
            low[q] += cell * width[q]
            high[q] = min(high[q], low[q] + width[q] - 1)
    return low, need


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score of the k best candidates of each query."""
    spark = df.sparkSession
    vectors = staged(quantised(df, id_col, vector_col, scale), "topk-vectors")
    asked = staged(vectors.where(F.col("id") % every == 0).withColumn("dim", F.size("x")), "topk-queries")
    base, parts = new_folder(spark, "topk-result"), 0
    for (dim,) in sorted(asked.select("dim").distinct().collect()):
        per_block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * max(1, dim))))
        own = asked.where(F.col("dim") == dim)
        blocks = -(-own.count() // per_block) * 2  # of half the bytes on average, as ids are dealt out by hash
        for b in range(blocks):
            rows = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "x").toArrow().combine_chunks().to_batches()
            if not rows:
                continue
            ids, q = _matrix(rows[0], dim)
            block = spark.sparkContext.broadcast((ids, q))
            kth, ties = _select(vectors, block, len(ids), k)
            chosen = vectors.mapInArrow(_chosen(block, kth, ties), "query_id long, q long, vec_id long, score long")
            place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
            chosen.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{base}/{parts}")
            parts += 1
            block.unpersist()
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(*[f"{base}/{i}" for i in range(parts)]) if parts else spark.createDataFrame([], schema)
