"""Near-duplicates of embeddings by product quantisation: coarse inverted lists, codes of residuals in subspaces, distances between
codes over sufficient probes, and exact cosines of what remains.

No link is lost. On unit vectors, cosine >= c means a distance of at most t = sqrt(2 - 2c). A partner of x can be in list j
only if x is within t of the cell boundary towards j, so exactly those lists are probed. And |x - y| >= |code(x) - code(y)| -
|x - code(x)| - |y - code(y)|, so a pair is given up only if its codes are further apart than t plus both coding errors. That
holds in any leading subspaces too. The subspaces lie along the principal axes, so few of them give up almost all pairs.

Only codes are dealt out to the pairs of blocks. Pairs that their codes leave form candidate components; the vectors of these
meet within their component, by exact cosines.

Semantics. Vectors that are null, zero, or hold null or non-finite components link with nothing; so do those of null ids (their
component is null). Vectors of different lengths do not link. Equal vectors form a class, of which one member is compared. Rows
that repeat an id are one node, whose links add up. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Sets, drop_staged, groups, join_counted, staged
from .components import components

#: The index is fitted on at most about FIT_ROWS vectors, its codebooks on BOOK_ROWS of them; every vector is indexed. There is a list for
#: LIST_ROWS vectors: as no link may be lost, vectors without clusters visit a large part of all lists whatever their number, so many
#: small lists only cost more copies.
FIT_ROWS, BOOK_ROWS, LIST_ROWS, MOST_LISTS, CODES, SUB = 20_000, 4096, 32_768, 4096, 256, 2
#: Vectors of a block of codes, and of vectors; a task compares two blocks. A block of codes takes at most BLOCK_BYTES decoded, and has fewer
#: vectors, but FEWEST at least, where there would be fewer than PARTS blocks in all.
BLOCK, VECTOR_BLOCK, BLOCK_BYTES, FEWEST, PARTS = 65_536, 4096, 16 << 20, 4096, 8
#: Groups of codes are dealt out over a task for PAIRS vectors' pairs, and over MOST_PARTS at most.
PAIRS, MOST_PARTS = 1 << 25, 2000
#: Queries and targets that are compared at a time.
TILE = 512, 4096
#: Candidate components of at most SMALL vectors share groups of about TOGETHER vectors.
SMALL, TOGETHER = 256, 1024
#: Numbers of leading dimensions that may be compared before all are, and what a remaining pair costs against one of a matrix product.
HEADS, PAIR_COST = (8, 16, 24, 32, 48, 64, 96, 128, 192, 256), 30
#: Room for single precision in squared distances.
SLACK = 2e-4


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, and squared distances to all."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return d.argmin(axis=1), np.maximum(d, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[at : at + 4096], centres)[0] for at in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Principal axes, coarse centres and codebooks of one vector length; pads to whole subspaces."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.dim, self.axes = sample.shape[1], np.eye(sample.shape[1])
        x = self.unit(sample)[:, : self.dim]
        middle = x - x.mean(axis=0)
        self.axes = np.linalg.eigh(middle.T @ middle)[1][:, ::-1]
        x = self.unit(sample)
        self.centres = k_means(x, max(1, min(MOST_LISTS, n // LIST_ROWS))).astype(np.float32).astype(np.float64)  # single precision holds them
        x = x[:: -(-len(x) // BOOK_ROWS)]
        rest = (x - self.centres[self.own(x)]).astype(np.float32)
        self.books = [k_means(rest[:, at : at + SUB], CODES, 5, at + 2) for at in range(0, x.shape[1], SUB)]
        #: What is dealt out of a vector: its list, its codes, and its coding errors in the leading dimensions and in all.
        self.record = np.dtype([("own", "<i4"), ("head", "<f4"), ("error", "<f4"), ("codes", "u1", (len(self.books),))])

    def unit(self, raw: np.ndarray) -> np.ndarray:
        x = raw / np.abs(raw).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        return np.pad(x @ self.axes, ((0, 0), (0, -x.shape[1] % SUB)))

    def own(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_nearest(x[at : at + 4096], self.centres)[0] for at in range(0, len(x), 4096)])

    def code(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the coding errors."""
        rest = (x - self.centres[own]).astype(np.float32)
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            codes[:, m] = ((book * book).sum(axis=1) - rest[:, m * SUB : m * SUB + SUB] @ (2 * book.T)).argmin(axis=1)
        return codes, self.errors(x, own, codes)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for, in single precision."""
        back = self.centres[own].astype(np.float32)
        for m, book in enumerate(self.books):
            back[:, m * SUB : m * SUB + SUB] += book[codes[:, m]]
        return back

    def errors(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray, head: int | None = None) -> np.ndarray:
        return np.sqrt(((x - self.decoded(own, codes))[:, :head] ** 2).sum(axis=1))

    def head(self, x: np.ndarray, reach: float) -> int:
        """The number of leading dimensions that gives up pairs of x with the least work; of all, if fewer don't help."""
        x = x[:: -(-len(x) // 1024)]
        own = self.own(x)
        codes, errors = self.code(x, own)
        back, width = self.decoded(own, codes), x.shape[1]

        def remaining(head: int) -> float:
            left, right = _sides(back[:, :head], self.errors(x, own, codes, head), reach)
            return float((left @ right.T >= 0).mean())

        least = remaining(width)
        return min([width, *(h for h in HEADS if h < width)], key=lambda h: h + PAIR_COST * width * (remaining(h) - least))

    def probes(self, x: np.ndarray, reach: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own lists, and (row, list) of the higher lists in which a vector within reach may be; of these the `most` nearest, if given."""
        own, d = _nearest(x, self.centres)
        between = np.sqrt(_nearest(self.centres[own], self.centres)[1])
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * reach * between + 1e-9
        if most is not None and most < len(self.centres):
            near &= d <= np.partition(d, most, axis=1)[:, most : most + 1]
        rows, lists = np.nonzero(near & (np.arange(len(self.centres))[None, :] > own[:, None]))
        return own, rows, lists

    def distances(self, x: np.ndarray, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of x's rows to the coded vectors of a list."""
        return _nearest(x, self.decoded(np.full(len(codes), of_list), codes).astype(np.float64))[1]


def _sides(decoded: np.ndarray, errors: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b whose product is negative only if two codes are further apart than reach plus both errors, e and f: the bound is
    (reach^2 / 2 + 2 reach e + 2 e^2) + (the same of f), at least (reach + e + f)^2."""
    errors = errors.astype(np.float64)
    half = (reach * reach / 2 + 2 * errors * (reach + errors) - (decoded.astype(np.float64) ** 2).sum(axis=1) + SLACK) / 2
    one = np.ones(len(half))
    return np.column_stack([decoded, half, one]).astype(np.float32), np.column_stack([decoded, one, half]).astype(np.float32)


def _vectors(column, kind: str) -> np.ndarray:
    """Rows of doubles from packed vectors, of the source's precision."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)


def _coded(index: Index, reach: float, kind: str, most: int | None, head: int):
    """One row per vector and list that it lives in (resident) or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                x = index.value.unit(_vectors(some.column("x"), kind))
                own, rows, lists = index.value.probes(x, reach, most)
                record = np.empty(len(some), index.value.record)
                record["own"] = own
                record["codes"], errors = index.value.code(x, own)
                for name, of in (("head", index.value.errors(x, own, record["codes"], head)), ("error", errors)):
                    record[name] = np.nextafter(of.astype(np.float32), np.float32(np.inf))
                take = np.concatenate([np.arange(len(some)), rows])
                resident = np.arange(len(take)) < len(some)
                code = pa.array([r.tobytes() for r in record], pa.binary()).take(pa.array(take))
                ids = some.column("id").take(pa.array(take))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([own, lists]).astype(np.int64)), pa.array(resident), code], ["id", "list", "resident", "code"])

    return run


def _pair_of_blocks(rows: pa.Table, inner: bool, b1: int, b2: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the queries and of the targets; the same ones, if a block meets itself."""
    block, resident = rows.column("block").to_numpy(), rows.column("resident").to_numpy(zero_copy_only=False)
    return np.flatnonzero(block == b1) if inner else np.flatnonzero(~resident), np.flatnonzero(resident & (block == b2))


def _tiles(queries: int, targets: int, itself: bool) -> Iterator[tuple[slice, slice]]:
    """Tiles of queries with targets; only those that hold a pair i < j, if a block meets itself."""
    for at in range(0, queries, TILE[0]):
        for to in range(at if itself else 0, targets, TILE[1]):
            yield slice(at, at + TILE[0]), slice(to, to + TILE[1])


def _candidates(index: Index, reach: float, head: int):
    """Within a group of (list, inner, b1, b2): spanning edges (u, v) of the pairs that their codes do not give up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, inner, b1, b2), rows in groups(batches, 4):
            queries, targets = _pair_of_blocks(rows, inner, b1, b2)
            record = np.frombuffer(b"".join(rows.column("code").to_pylist()), index.value.record)
            back = index.value.decoded(record["own"], record["codes"])
            left, right = _sides(back, record["error"], reach)
            left, right = left[queries], right[targets]
            few = head < back.shape[1]
            if few:
                first, second = _sides(back[:, :head], record["head"], reach)
                first, second = first[queries], second[targets]
            sets, itself = Sets(len(rows)), bool(inner and b1 == b2)
            for q, t in _tiles(len(queries), len(targets), itself):
                at, to = queries[q], targets[t]
                if (sets.root[at] == sets.root[at[0]]).all() and (sets.root[to] == sets.root[at[0]]).all():
                    continue
                near = first[q] @ second[t].T if few else left[q] @ right[t].T
                some = np.flatnonzero(near.max(axis=1) >= 0)
                i, j = np.nonzero(near[some] >= 0)
                i = some[i]
                if few and len(i) * PAIR_COST > near.size:
                    i, j = np.nonzero(left[q] @ right[t].T >= 0)
                elif few:
                    remain = np.einsum("ij,ij->i", left[q][i], right[t][j]) >= 0
                    i, j = i[remain], j[remain]
                sets.merge(at[i], to[j])
            u, v = sets.spanning()
            ids = rows.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    return run


def _links(cosine: float, kind: str):
    """Within a group of (list, inner, b1, b2): weights of links per vector (u, null, w) and spanning edges (u, v, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, inner, b1, b2), rows in groups(batches, 4):
            queries, targets = _pair_of_blocks(rows, inner, b1, b2)
            ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
            raw = _vectors(rows.column("x"), kind)
            raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])  # exact, and no square overflows
            norms = np.sqrt((raw * raw).sum(axis=1))
            room = 1e-12 * raw.shape[1]  # for sums of products in another order
            weights, sets, itself = np.zeros(len(ids), np.int64), Sets(len(ids)), bool(inner and b1 == b2)
            for q, t in _tiles(len(queries), len(targets), itself):
                at, to = queries[q], targets[t]
                over = raw[at] @ raw[to].T - cosine * norms[at][:, None] * norms[to][None, :]
                i, j = np.nonzero(over >= -room)
                sure = over[i, j] > room
                i, j = at[i], to[j]
                for some in np.array_split(np.flatnonzero(~sure), 1 + len(sure) * raw.shape[1] // (BLOCK_BYTES // 4)):
                    a, b = i[some], j[some]
                    sure[some] = np.einsum("ij,ij->i", raw[a], raw[b]) >= cosine * norms[a] * norms[b]
                if itself:
                    sure &= i < j
                i, j = i[sure], j[sure]
                np.add.at(weights, i, n[j])
                np.add.at(weights, j, n[i])
                sets.merge(i, j)
            there = np.flatnonzero(weights)
            u, v = sets.spanning()
            nothing = [None] * (len(there) + len(u))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[there], ids[u]])), pa.array(nothing[: len(there)] + ids[v].tolist(), pa.int64()),
                    pa.array(weights[there].tolist() + nothing[: len(u)], pa.int64()),
                ],
                ["u", "v", "w"],
            )

    return run


def _dealt(placed: DataFrame, block: int, parts: int, *payload: str) -> DataFrame:
    """Rows by group: pairs of blocks of a list's residents (inner), and blocks of visitors with blocks of residents."""
    sizes = placed.groupBy("list").agg(F.count(F.when(F.col("resident"), 1)).alias("n_in"), F.count(F.when(~F.col("resident"), 1)).alias("n_out"))
    known = placed.join(sizes, "list").where("n_in > 0")
    n_in, n_out = F.ceil(F.col("n_in") / block).cast("int"), F.ceil(F.col("n_out") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("resident"), n_in).otherwise(n_out)).cast("int")
    known = known.withColumn("own", own)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda inner, b1, b2: F.struct(F.lit(inner).alias("inner"), b1.alias("b1"), b2.alias("b2"), F.col("own").alias("block"))
    mine = F.transform(upto(n_in), lambda b: group(True, F.least(b, F.col("own")), F.greatest(b, F.col("own"))))
    received = F.transform(upto(n_out), lambda b: group(False, b, F.col("own")))
    visits = F.transform(upto(n_in), lambda b: group(False, F.col("own"), b))
    spread = known.withColumn("g", F.explode(F.when(F.col("resident"), F.concat(mine, received)).otherwise(visits)))
    columns = ["list", "g.inner", "g.b1", "g.b2", "g.block", "resident", "id", *payload]
    return spread.select(*columns).repartition(parts, "list", "inner", "b1", "b2").sortWithinPartitions("list", "inner", "b1", "b2")


def _grouped(named: DataFrame, total: int) -> DataFrame:
    """(id, list, resident): a list for each large candidate component, and lists of many small ones, whose vectors may meet as well."""
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, total // TOGETHER)))
    of = F.when(F.col("size") <= SMALL, bucket).otherwise(F.col("component"))
    return join_counted(named, sizes, ["component"], "size", total).select("id", of.alias("list"), F.lit(True).alias("resident"))


def _packed(vectors: DataFrame, dim: int, kind: str) -> DataFrame:
    """Vectors as bytes of the source's floats; other columns as they are."""
    types = ", ".join(f"{f.name} {'binary' if f.name == 'x' else f.dataType.simpleString()}" for f in vectors.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(batch), dim)
            yield batch.set_column(at, "x", pa.array([r.tobytes() for r in flat], pa.binary()))

    return vectors.mapInArrow(run, types)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, block: int = BLOCK, probes: int | None = None) -> DataFrame:
    """One row per row of df: id, n_links, component_id, kept. probes: besides its own list, a vector visits so many of the nearest at most; without
    it, all that may hold a partner, and no link is lost."""
    spark, reach = df.sparkSession, math.sqrt(2 - 2 * cosine) + 1e-9
    kind = "<f4" if isinstance(getattr(df.schema[vector_col].dataType, "elementType", None), FloatType) else "<f8"
    all_rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda c: c != 0)
    keyed = all_rows.select("id", F.when(usable, F.col("x")).alias("x")).select("id", "x", F.size("x").alias("dim"), F.xxhash64("x").alias("h"), F.hash("x").alias("g"))
    keyed = staged(keyed, "pq-vectors")
    there = keyed.where("x is not null")
    classes = staged(there.groupBy("dim", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "pq-classes")
    known = there.select("dim", "h", "g", F.col("id").alias("rep"), "x").join(classes, ["dim", "h", "g", "rep"])
    reps = staged(known.dropDuplicates(["dim", "h", "g"]).select(F.col("rep").alias("id"), "n", "dim", "x"), "pq-representatives")

    met, found = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "u long, v long, w long")
    lengths = sorted(tuple(r) for r in reps.groupBy("dim").count().where("count > 1").collect())
    for dim, n in lengths:
        own = _packed(reps.where(F.col("dim") == dim).select("id", "n", "x"), dim, kind)
        one_in = -(-n // FIT_ROWS)
        sample = own.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).limit(2 * FIT_ROWS).select("x").toArrow().column(0).to_pylist() or [own.first().x]
        sample = np.frombuffer(b"".join(sample), kind).reshape(len(sample), dim).astype(np.float64)
        fitted = Index(sample, n)
        head, index = fitted.head(fitted.unit(sample), reach), spark.sparkContext.broadcast(fitted)
        size = min(block, max(FEWEST, -(-n // PARTS)), max(1024, BLOCK_BYTES // (4 * dim)))
        blocks = -(-n // size)
        coded = staged(own.mapInArrow(_coded(index, reach, kind, probes, head), "id long, list long, resident boolean, code binary"), "pq-lists")
        dealt = _dealt(coded, size, min(MOST_PARTS, blocks * (blocks + 1) // 2, -(-n * n // (2 * PAIRS))), "code")
        met = met.unionByName(staged(dealt.mapInArrow(_candidates(index, reach, head), "u long, v long"), "pq-candidates"))
        drop_staged(coded)

    named = staged(components(met), "pq-components")
    total = named.count()
    lists = staged(_grouped(named, total), "pq-groups")
    for dim, _ in lengths if total else []:
        size = min(block, VECTOR_BLOCK, max(1024, BLOCK_BYTES // (4 * dim)))
        vectors = _packed(reps.where(F.col("dim") == dim).join(lists, "id").select("id", "n", "x", "list", "resident"), dim, kind)
        dealt = _dealt(vectors, size, min(MOST_PARTS, -(-total // TOGETHER)), "n", "x")
        found = found.unionByName(staged(dealt.mapInArrow(_links(cosine, kind), "u long, v long, w long"), "pq-links"))

    joined = components(found.where("v is not null").select("u", "v")).withColumnRenamed("id", "rep")
    counted = found.where("w is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("w").alias("w"))
    of_class = classes.join(counted, "rep", "left").join(joined, "rep", "left")
    named = of_class.select("dim", "h", "g", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    kept = there.select("id", "dim", "h", "g").join(named, ["dim", "h", "g"]).select("id", F.col("links"), "component")
    rest = keyed.where("x is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = kept.unionByName(rest).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
