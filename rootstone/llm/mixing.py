"""Mixing sources to target weights by pivotal dependent rounding.

Every document wants target / source size copies. The whole part is taken; fractions meet in pairs, which randomly pass mass
to each other until one of them is 0 or 1. Groups of similar documents are rounded side by side and leave one fraction at
most; fractions left over meet in the next level's groups, a reduction tree that ends with one fraction per source, which
a last draw rounds. Sums of copies are kept throughout, and each document is taken with its own probability. Partners follow each other by
size, so that mass passes between documents of similar size and words come near the targets.

Semantics. A size is the number of words (ASCII white space separates them); null texts have 0. Sources are ranked by
code point, null last, and weigh as `weights` repeating; they share the sum of all sizes. No target exceeds `cap` times its
source's size; what is above goes to the other sources by weight until none is above. Documents equal in id, source and size are
one unit: all its rows get the same number of copies. Null ids are values like others. Draws depend on ids, sizes and
`seed` only, so reruns agree. Empty tables give empty results; other columns, whatever their names, are passed on unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, groups, mix64, staged

#: Units of a group of the tree.
FAN_IN = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: source, n_units, source_size, target. The only ordered step is over one row per source."""
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = staged(totals.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).cast("double")), "mix-sources")
    most = F.col("source_size") * cap
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        n, fixed, free, total = sources.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, most).otherwise(0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0)), F.sum("source_size")
        ).first()
        if n == capped or not free:
            break
        level, capped = ((total or 0) - (fixed or 0)) / free, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), most.cast("double")))


def pivot(p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Sequential pivotal rounding of fractions in (0, 1). All but one of the results are 0 or 1."""
    p, out = p.tolist(), np.zeros(len(p))
    held, a = -1, 0.0
    for j, (b, u) in enumerate(zip(p, draws.tolist(), strict=True)):
        if held < 0:
            held, a = j, b
            continue
        both = a + b
        if both < 1:  # one is done with 0, the other holds the sum
            ended, rest, last = (j, 0.0, both) if u * both < a else (held, 0.0, both)
        else:  # one is done with 1, the other holds what is left
            ended, rest, last = (held, 1.0, both - 1) if u * (2 - both) < 1 - b else (j, 1.0, both - 1)
        out[ended] = rest
        held, a = (held if ended == j else j), last
        if a < 1e-9 or a > 1 - 1e-9:
            out[held], held = round(a), -1
    if held >= 0:
        out[held] = a
    return out


def _round(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 2):
            h = rows.column("h").to_numpy().view(np.uint64)
            mixed = mix64(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
            p = pivot(rows.column("p").to_numpy(), (mixed >> np.uint64(11)) / float(1 << 53))
            if last:
                final = (mix64(mixed) >> np.uint64(11)) / float(1 << 53)
                p = np.where((p > 0) & (p < 1), (final < p).astype(float), p)
            yield from rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p)).to_batches()

    return run


def decide(units: DataFrame, sources: DataFrame, seed: int = 1) -> DataFrame:
    """units (id, source, size, m) with n copies, and their source's source_size and target."""
    known = sources.select(F.col("source").alias("s"), "n_units", "source_size", "target")
    joined = units.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + 1e-9)
    h = F.xxhash64("id", "source", "size")
    salts = F.ceil(F.col("n_units") / FAN_IN)
    rows = joined.select(
        F.xxhash64("source").alias("group"), F.pmod(h, salts).alias("salt"), "id", "source", "size", "m", "source_size", "target", h.alias("h"),
        whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), wanted - whole).alias("p"),
    )
    at_most = sources.agg(F.max(F.ceil(F.col("n_units") / FAN_IN))).first()[0] or 1
    fraction = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    done = rows.where(~fraction)
    left, level = rows.where(fraction), 0
    while True:
        dealt = left.repartition("group", "salt").sortWithinPartitions("group", "salt", F.desc(F.col("size") * F.col("m")), "h", "size")
        rounded = staged(dealt.mapInArrow(_round(seed + level, at_most == 1), rows.schema), "mix-level")
        done = done.unionByName(rounded.where(~fraction))
        if at_most == 1:
            break
        at_most, level = -(-at_most // FAN_IN), level + 1
        left = rounded.where(fraction).withColumn("salt", F.floor(F.col("salt") / FAN_IN))
    return done.select("id", "source", "size", "m", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """One row per unit: id, source, size, m (rows of docs), source_size, target, copies of each row."""
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    units = staged(sized.groupBy("id", "source", "size").agg(F.count("*").alias("m")), "mix-units")
    return decide(units, source_targets(units), seed)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    taken = mix(docs, id_col, text_col, source_col, seed).where("copies > 0").select("id", "source", "size", "copies")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # their names cannot clash with others
    field = lambda c: F.col("row")[c]
    same = field(id_col).eqNullSafe(F.col("id")) & field(source_col).eqNullSafe(F.col("source")) & (word_count(field(text_col)) == F.col("size"))
    times = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return rows.join(taken, same).select("row", F.explode(times).alias("one")).select("row.*")
