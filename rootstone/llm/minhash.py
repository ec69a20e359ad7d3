"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

Semantics. A document's set holds the distinct `width`-word shingles of its lower-cased (A-Z only) text; a text of fewer
words is one shingle, a text without words (or null) has the empty set and is linked with nothing. Two documents are linked
if 100 * |intersection| >= percent * |union|. A component is named by its smallest id. Shingles are told apart by 64-bit hashes.

What is lost. A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^rows)^bands, about 7e-10 by default. Signatures of two documents
that share a bucket must agree in a share `agreement` of their places; at similarity 0.8 that share of 160 places has a standard deviation of 0.032,
so 0.6 lies more than six of them below and loses about 2e-10 of such pairs. agreement=0 confirms every pair that shares a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sets, groups, join_counted, linked, lowered, mix64, staged, word_hashes
from .components import components

BANDS, ROWS = 40, 4
AGREEMENT = 0.6
#: Bytes of text of a block of a family, besides its number of rows.
FAMILY_BYTES = 8 << 20
ANY, TARGET, QUERY = 0, 1, 2


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    words, counts = word_hashes(texts)
    at = 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        if n == 0:
            yield np.zeros(0, np.uint64)
            continue
        k = min(n, width)
        sums = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            sums += w[j : n - k + 1 + j] * factors[j]
        yield np.unique(mix64(sums))


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n multiply-add-shift hash functions, a universal family."""
    draws = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return draws[:n] | np.uint64(1), draws[n:]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of a non-empty set under each function."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 256):
        block = shingles[at : at + 256]
        np.minimum(out, ((a[:, None] * block[None, :] + b[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def _signatures(width: int, bands: int, rows: int, seed: int):
    a, b = coefficients(bands * rows, seed)
    mixers = mix64(np.arange(1, rows + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                given = [batch.column(i).slice(at, 512) for i in (0, 2, 3)]
                texts = [lowered(t) for t in batch.column(1).slice(at, 512).to_pylist()]
                n, h1, h2, sig, keys = [], [], [], [], []
                for s in shingle_sets(texts, width):
                    n.append(len(s))
                    if not len(s):
                        h1.append(0), h2.append(0), sig.append(None), keys.append(None)
                        continue
                    h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)))
                    m = minima(s, a, b)
                    sig.append(m.astype(np.uint8).tobytes())
                    keys.append(mix64((m.astype(np.uint64).reshape(bands, rows) * mixers).sum(axis=1, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*given, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "t", "size", "n_shingles", "h1", "h2", "sig", "keys"],
                )

    return run


def _agreeing(least: float):
    """Within one bucket: spanning edges of the graph of signatures that agree in at least this share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 3):
            ids = rows.column("id").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            need = least * sig.shape[1]
            u, v = linked(len(ids), lambda i, others: (sig[others] == sig[i]).sum(axis=1) >= need).spanning()  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["u", "v"])

    return run


def _confirmed(width: int, percent: int, least: float):
    """Within one block of a family: edges of the exact links, found on whole sets, that span its components; where there are queries, those of
    queries with targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 3):
            ids, role = rows.column("id").to_numpy(), rows.column("role").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            sets = list(shingle_sets([lowered(t) for t in rows.column("text").to_pylist()], width))
            sizes, need = np.array([len(s) for s in sets]), least * sig.shape[1]

            def alike(i: int, others: np.ndarray) -> np.ndarray:
                small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])  # noqa: B023
                maybe = np.flatnonzero((100 * small >= percent * large) & ((sig[others] == sig[i]).sum(axis=1) >= need))  # noqa: B023
                out = np.zeros(len(others), bool)
                own = sets[i]  # noqa: B023
                for at in range(0, len(maybe), 64):
                    part = maybe[at : at + 64]
                    theirs = [sets[j] for j in others[part]]  # noqa: B023
                    flat = np.concatenate(theirs)
                    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    n = np.array([len(s) for s in theirs])
                    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
                    out[part] = 100 * common >= percent * (n + len(own) - common)
                return out

            queries, targets = np.flatnonzero(role == QUERY), np.flatnonzero(role == TARGET)
            if (role == ANY).any():
                u, v = linked(len(ids), alike).spanning()
            else:
                joined, u, v = Sets(len(ids)), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for q in queries.tolist():
                    others = targets[joined.root[targets] != joined.root[q]]
                    if len(others) and len(found := others[alike(q, others)]):
                        one = found[np.unique(joined.root[found], return_index=True)[1]]  # of each component that q joins
                        joined.join(q, found)
                        u, v = np.append(u, one), np.append(v, np.full(len(one), q))
            yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["u", "v"])

    return run


def _blocks(rows: DataFrame, size: Column, per_block: int) -> DataFrame:
    """Adds (b1, b2): each row goes to all pairs of blocks that its own block is part of; one pair where all fit in a block."""
    n = F.ceil(size / F.lit(per_block)).cast("long")
    own = F.pmod(F.xxhash64("id"), n)
    return (
        rows.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        .withColumn("b1", F.least("b", own))
        .withColumn("b2", F.greatest("b", own))
        .drop("b")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 1,
    bucket_block: int = 4096,
    family_block: int = 512,
    agreement: float = AGREEMENT,
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id and kept (id is its component's least).

    1. Every whole text becomes a set, its minima and band keys in one pass; sets that are equal form a class, and only one row
       of the class goes on. 2. In each bucket (equal band key) signatures are compared; spanning edges join families.
       3. In each family links are confirmed on whole sets. A family larger than a block (in rows or bytes) first meets one leader, block by
       block; members that link with it are joined, and only the others meet the whole family, as pairs of blocks. So a family
       of copies costs one pass, and no task holds more than two blocks. 4. Components of the links.

    Null, empty and white texts: n_shingles 0, a component of their own. Null ids: component_id null, kept true. Rows that
    repeat an id are one document with several texts, all of which count. Other columns of docs are not read.
    """
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    schema = "id long, t long, size long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>"
    sized = source.select("id", "text", "t", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    signed = staged(sized.mapInArrow(_signatures(width, bands, rows, seed), schema), "minhash-signatures")
    there, equal = signed.where("id is not null and n_shingles > 0"), ["n_shingles", "h1", "h2"]
    classes = there.groupBy(*equal).agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("n"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "minhash-sets")
    total = there.count()
    members = staged(join_counted(there.select("id", *equal), classes.select(*equal, "class", "n"), equal, "n", total).select("id", "n_shingles", "class"), "minhash-classes")
    chosen = classes.select(*equal, "rep.id", "rep.t", "class")
    reps = there.join(chosen, [*equal, "id", "t"]).dropDuplicates(["class"])
    reps = staged(reps.select(F.col("class").alias("id"), F.col("id").alias("doc"), "t", "size", "sig", "keys"), "minhash-representatives")
    banded = reps.select("id", F.posexplode("keys")).select("id", F.xxhash64("pos", "col").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    in_blocks = _blocks(banded.join(full, "key"), F.col("n"), bucket_block).join(reps.select("id", "sig"), "id")
    dealt = in_blocks.select("key", "b1", "b2", "id", "sig").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "id")
    families = staged(components(dealt.mapInArrow(_agreeing(agreement), "u long, v long")), "minhash-families")

    of_family = families.join(reps.select("id", "doc", "t", "size", "sig"), "id")
    sizes = of_family.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / family_block), F.ceil(F.col("bytes") / FAMILY_BYTES)).cast("long")
    texts = source.join(of_family.select(F.col("doc").alias("id"), "t"), ["id", "t"], "left_semi").dropDuplicates(["id", "t"]).withColumnRenamed("id", "doc")
    known = join_counted(of_family, sizes.select("component", "n", blocks.alias("blocks")), ["component"], "n", total).join(texts, ["doc", "t"])
    whole = staged(known.select("component", "n", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("own"), "id", "sig", "text"), "minhash-texts")
    small, big = whole.where("blocks = 1"), whole.where("blocks > 1")

    def as_group(some: DataFrame, b1: Column, b2: Column, role: int) -> DataFrame:
        return some.select("component", b1.alias("b1"), b2.alias("b2"), "id", F.lit(role).alias("role"), "sig", "text")

    def confirmed(some: DataFrame) -> DataFrame:
        dealt = some.repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "role", "id")
        return dealt.mapInArrow(_confirmed(width, percent, agreement), "u long, v long")

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    led = as_group(big.where("id <> component"), F.col("own"), F.lit(-1).cast("long"), TARGET).unionByName(as_group(big.where("id = component"), every("blocks"), F.lit(-1).cast("long"), QUERY))
    links = staged(confirmed(as_group(small, F.lit(0).cast("long"), F.lit(0).cast("long"), ANY).unionByName(led)), "minhash-links")
    alone = big.where("id <> component").join(links.select(F.col("u").alias("id")).distinct(), "id", "left_anti")
    left = alone.groupBy("component").agg(F.count("*").alias("m"), F.first("n").alias("n")).select("component", "n", F.ceil(F.col("m") / family_block).cast("long").alias("parts"))
    asked = join_counted(alone.drop("n"), left, ["component"], "n", total)
    targets = join_counted(big.drop("n"), left, ["component"], "n", total)
    rest = as_group(asked, F.pmod(F.xxhash64("id"), "parts"), every("blocks"), QUERY).unionByName(as_group(targets, every("parts"), F.col("own"), TARGET))

    several = members.groupBy("id").agg(F.collect_set("class").alias("classes")).where("size(classes) > 1")  # documents with several texts
    ties = several.select(F.array_min("classes").alias("u"), F.explode("classes").alias("v"))
    joined = components(links.unionByName(confirmed(rest)).unionByName(ties)).withColumnRenamed("id", "class")
    named = classes.select("class", "n", F.col("rep.id").alias("rep")).join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = join_counted(named, named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")), ["component"], "k", total)
    found = join_counted(members, least.select("class", "n", "component_id"), ["class"], "n", total).select("id", "n_shingles", "component_id")
    empty = signed.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = found.unionByName(empty).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
