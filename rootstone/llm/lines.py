"""Line deduplication: hashes of lines are dealt out by range and sorted by document and position; repeated lines are found
as they stream by, and only compressed per-document bitmaps travel back to the texts.

Semantics. A text is split at \\n (null and empty: one empty line). A line's key is the line with ASCII white space stripped
at both ends and A-Z lower-cased; two keys are the same if their 96 bits of hash are. A key of at least one code point
that occurs in at least `min_docs` documents repeats. Mode "all" drops all its lines, mode "first" all but its first
occurrence by (id, text hash, position); rows of equal id and text share that occurrence and each keep it. All other lines stay,
joined by \\n; other columns, whatever their names, are passed on unread. Rows that repeat an id count as one document, null ids as one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, staged

#: Documents in the sample that finds hot keys, and the lines that make a key hot, by its estimate: HOT_ROWS, or one in HOT_MOST of all lines where
#: that is more. So no key that streams by is longer than that, and about HOT_MOST keys are broadcast at most. The sample steers how
#: rows are dealt out, never the result.
HOT_SAMPLE, HOT_ROWS, HOT_MOST = 100_000, 20_000, 20_000
WORD_BITS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Per line (h, g), two hashes of its key, or null for an empty key."""

    def one(line: Column) -> Column:
        key = ascii_lower(F.trim(line, F.lit(SPACE)))
        return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g")))

    return F.transform(_lines(text), one)


def _hot(keyed: DataFrame) -> DataFrame:
    one_in = max(1, keyed.count() // HOT_SAMPLE)
    sample = keyed.where(F.pmod(F.xxhash64("id", "t"), F.lit(one_in)) == 0)
    total = sample.agg(F.sum(F.size("keys"))).first()[0] or 0
    counted = sample.select(F.explode("keys").alias("k")).where("k is not null").groupBy("k.h", "k.g").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") * one_in > max(HOT_ROWS, one_in * total // HOT_MOST)).select("h", "g")


def repeated(keyed: DataFrame, min_docs: int, first: bool) -> DataFrame:
    """(id, t, pos) of the lines to drop. keyed: id, t (hash of the text) and keys."""
    hot = staged(_hot(keyed), "lines-hot")
    rows = keyed.select("id", "t", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("k.h", "k.g", "id", "t", "pos")

    cool = rows.join(F.broadcast(hot), ["h", "g"], "left_anti").repartitionByRange("h", "g").sortWithinPartitions("h", "g", "id", "t", "pos")
    run = Window.partitionBy("h", "g")
    in_order = run.orderBy("id", "t", "pos")
    place = F.row_number().over(in_order)
    fresh = (place == 1) | ~F.col("id").eqNullSafe(F.lag("id").over(in_order))
    ranked = cool.select("*", F.rank().over(in_order).alias("rank"), fresh.cast("int").alias("fresh"))  # repeated rows share a rank
    streamed = ranked.select("*", F.sum("fresh").over(run).alias("n_docs"))
    found = streamed.where(F.col("n_docs") >= min_docs)
    if first:
        found = found.where("rank > 1")

    of_hot = rows.join(F.broadcast(hot), ["h", "g"])
    at = F.struct("id", "t", "pos")
    counted = of_hot.groupBy("h", "g", "id").agg(F.min(at).alias("at")).groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.min("at").alias("at"))
    found_hot = of_hot.join(F.broadcast(counted.where(F.col("n_docs") >= min_docs).select("h", "g", F.col("at").alias("first_at"))), ["h", "g"])
    if first:
        found_hot = found_hot.where(at != F.col("first_at"))
    return found.select("id", "t", "pos").unionByName(found_hot.select("id", "t", "pos"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """Per text (id, t): n_dropped and a bitmap of dropped lines, as a map from word number to 32 bits. Empty words are left out."""
    bit = F.expr(f"shiftleft(1L, pos % {WORD_BITS})")
    words = dropped.distinct().groupBy("id", "t", F.expr(f"pos div {WORD_BITS}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("id", "t").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap")
    )


def keyed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("t"), line_keys(docs[text_col]).alias("keys"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, first: bool = False) -> DataFrame:
    """The operator's compact result: (id, t, n_dropped, bitmap) of every text that loses a line."""
    return bitmaps(repeated(staged(keyed_lines(docs, id_col, text_col), "line-keys"), min_docs, first))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, first: bool = False, counts: bool = True) -> DataFrame:
    """docs with the repeated lines gone from text_col; with counts also n_lines, n_dropped (replacing columns of these names)."""
    marks = line_bitmaps(docs, id_col, text_col, min_docs, first)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # their names cannot clash with others
    field = lambda c: F.col("row")[c]
    joined = rows.join(marks, field(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(field(text_col)) == F.col("t")), "left")
    lines = _lines(field(text_col))

    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(F.try_element_at(F.col("bitmap"), F.floor(i / WORD_BITS).cast("int")), F.lit(0).cast("long"))
        return F.getbit(bits, i % WORD_BITS) == 0

    kept = F.when(F.col("bitmap").isNull(), field(text_col)).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    added = [F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    columns = [(kept if c == text_col else field(c)).alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, *added)
