"""Toxicity by class-conditional Kneser-Ney models of how words are spelt.

Two models, of toxic and of ordinary documents, give a word's log-likelihood from the six-grams of its bytes (ends
included). Each discounts its own counts and backs off to one shared model of orders five to one, whose counts are
continuations: of how many longer n-grams of either class an n-gram is the end. So expressions that a class has rarely
seen are smoothed alike. A document's log-likelihood ratios are normalised by length: over the whole text, over its best
window and over its best words; a logistic function of these three is the score.

What is calibrated: the logistic function, on at most about 2 * FIT_ROWS labelled documents of fold 3 (crc32 of the id as text, modulo 4). What
is counted: the words of all other labelled documents of folds 0, 1 and 3, by distributed aggregation. Fold 2 is never
learnt from. The counts are exact. As long as the tables of all distinct n-grams stay below TABLE_BYTES they are collected, sorted and sent to
the executors. Larger ones stay distributed: the ratios of the corpus's distinct words come from joins with the tables, order by order, and
meet the texts in chunks of CHUNK_BYTES. Both ways give the same ratios but for the rounding of sums; tests hold them against each other.

Semantics. Words are runs of digits, letters and non-ASCII characters, lower-cased in A-Z. Texts without words and null texts have ratios of
0, and the score that follows from them. A label 1 is toxic and 0 ordinary; others, and null, are not read. Without counted documents of both
classes every score is 0; without calibration rows of both, the score is the logistic function of the whole text's ratio. Rows that
repeat an id are scored each by itself, and repeated labels count each. Scores read the text alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lowered, staged

ORDER, DISCOUNT = 6, 0.75
FIT_ROWS, WINDOW, BEST = 20_000, 12, 3
THRESHOLD = 0.3
#: Distinct words whose ratios a worker keeps.
KEPT_WORDS = 400_000
#: The most bytes of n-gram tables that are collected and broadcast, and the most that an n-gram takes in them.
TABLE_BYTES, GRAM_BYTES = 256 << 20, 40
#: Bytes of texts that meet their words' ratios together; a longer text is a chunk by itself.
CHUNK_BYTES = 4 << 20
_START, _END = b"\x02", b"\x03"
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return lowered(text).translate(_TO_SPACE).split()


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def codes(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The six bytes that end at each byte of each word and at its end, as integers; and how many there are of each word."""
    pad = _START * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + w + _END for w in some), np.uint8).astype(np.uint64)
    n = np.array([len(w) + 1 for w in some])
    firsts = np.cumsum(n + ORDER - 1) - n
    at = np.arange(n.sum()) + np.repeat(firsts - (np.cumsum(n) - n), n)
    out = np.zeros(len(at), np.uint64)
    for j in range(ORDER):
        out |= data[at - j] << np.uint64(8 * j)
    return out, n


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of ordinary and toxic documents, added up per batch."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[int(toxic)].update(words(text))
        all_ = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(all_, pa.binary()), pa.array([counts[0][w] for w in all_], pa.int64()), pa.array([counts[1][w] for w in all_], pa.int64())], ["word", "n0", "n1"])


def _n_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        code, n = codes(batch.column(0).to_pylist())
        grams, place = np.unique(code, return_inverse=True)
        sums = [np.bincount(place, np.repeat(batch.column(i).to_numpy(), n), len(grams)).astype(np.int64) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *map(pa.array, sums)], ["gram", "n0", "n1"])


def low(code: Column, order: int) -> Column:
    """The last bytes of an n-gram."""
    return code.bitwiseAND(F.lit((1 << 8 * order) - 1))


def continuations(grams: DataFrame) -> dict[int, DataFrame]:
    """(gram, n) of the orders five to one: of how many distinct longer n-grams each one is the end."""
    found, longer = {}, grams
    for order in range(ORDER - 1, 0, -1):
        longer = found[order] = staged(longer.select(low(F.col("gram"), order).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "toxicity-continuations")
    return found


class Model:
    """Exact sorted tables. long: six-grams and their counts per class; contexts: of their first five bytes the totals and
    numbers of kinds; shared: per shorter order the n-grams, their continuations, and totals and kinds of their contexts."""

    def __init__(self, grams: DataFrame, shorter: dict[int, DataFrame] | None = None) -> None:
        self.long, self.contexts = self.tables(grams, ["n0", "n1"])
        self.shared = {order: self.tables(counted, ["n"]) for order, counted in (shorter or continuations(grams)).items()}

    @staticmethod
    def tables(grams: DataFrame, names: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Collects all n-grams: (codes, their counts) and (contexts, their totals and then kinds), each by rising code."""
        rows = grams.select("gram", *[F.col(n).cast("float").alias(n) for n in names]).toArrow()
        code = rows.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(code)
        code = code[order]
        n = np.stack([rows.column(name).to_numpy()[order] for name in names])
        context = code >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(context)])
        sums = np.concatenate([np.add.reduceat(x, first, axis=1, dtype=np.float64) for x in (n, n > 0)]) if len(first) else np.zeros((2 * len(names), 0))
        return (code, n), (context[first], sums.astype(np.float32))

    @staticmethod
    def found(table: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> np.ndarray:
        """The columns of a table at the codes, 0 where it has none."""
        keys, columns = table
        if not len(keys):
            return np.zeros((len(columns), len(code)), np.float32)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return np.where(keys[at] == code, columns[:, at], np.float32(0))

    @staticmethod
    def discounted(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney; contexts that were never seen leave it to the lower order."""
        seen = total > 0
        total = np.where(seen, total, 1)
        return np.where(seen, np.maximum(n - DISCOUNT, 0) / total + DISCOUNT * kinds / total * below, below)

    def ratios(self, some: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word if toxic, less that if ordinary."""
        every, n = codes(some)
        code, place = np.unique(every, return_inverse=True)
        p = np.full(len(code), 1 / 256)
        for order in range(1, ORDER):
            gram = code & np.uint64((1 << 8 * order) - 1)
            counts, contexts = self.shared[order]
            p = self.discounted(self.found(counts, gram)[0], *self.found(contexts, gram >> np.uint64(8)), p)
        counts, contexts = self.found(self.long, code), self.found(self.contexts, code >> np.uint64(8))
        ordinary, toxic = (self.discounted(counts[c], contexts[c], contexts[2 + c], p) for c in (0, 1))
        return np.add.reduceat((np.log(toxic) - np.log(ordinary))[place], np.cumsum(n) - n)


def calibrated(one_in: int) -> Column:
    """Whether a labelled row is one of those that fit the logistic function."""
    return (fold(F.col("id")) == 3) & (F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)


def count(docs: DataFrame, labels: DataFrame, one_in: int = 1) -> DataFrame:
    """(gram, n0, n1) of the words of labelled documents; docs: id, text; labels: id, toxic."""
    known = labels.where((fold(F.col("id")) != 2) & ~calibrated(one_in))
    # a sort-merge join however few labels there are: the plan of a small input is the plan of a large one
    texts = docs.where((fold(F.col("id")) != 2) & F.col("text").isNotNull()).join(known.hint("merge"), "id").select("text", F.col("toxic").cast("int").alias("toxic"))
    counted = texts.mapInArrow(_vocabulary, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return staged(counted.mapInArrow(_n_grams, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-grams")


def features(ratios: np.ndarray) -> tuple[float, float, float]:
    """Mean ratio, best mean of a window, mean of the best words."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0
    width = min(n, WINDOW)
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    best = np.partition(ratios, max(0, n - BEST))[-BEST:]
    return float(ratios.mean()), float((sums[width:] - sums[:-width]).max() / width), float(best.sum() / BEST)


def _measure(model):
    kept: dict[bytes, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [words(t) for t in part.column(part.schema.get_field_index("_text")).to_pylist()]
                new = list({w for ws in texts for w in ws}.difference(kept))
                if len(kept) + len(new) > KEPT_WORDS:
                    kept.clear()
                    new = list({w for ws in texts for w in ws})
                for i in range(0, len(new), 20_000):
                    some = new[i : i + 20_000]
                    kept.update(zip(some, model.value.ratios(some).tolist(), strict=True))
                found = [features(np.array([kept[w] for w in ws])) for ws in texts]
                rest = [part.column(i) for i, n in enumerate(part.schema.names) if n != "_text"]
                names = [n for n in part.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays([*rest, *[pa.array([f[i] for f in found], pa.float64()) for i in range(3)]], [*names, "f0", "f1", "f2"])

    return run


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers chunks of neighbouring rows; 64 bytes a row bound the rows without texts."""
    chunk, size = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        numbers = []
        for n in pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist():
            if size and size + n + 64 > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            size += n + 64
            numbers.append(chunk)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["id", "text", "chunk"])


def _word_id(word: bytes) -> bytes:
    return hashlib.blake2b(word, digest_size=16).digest()


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each run of rows of one chunk."""
    for batch in batches:
        for chunk, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), lambda r: r[0]):
            some = list({w for _, text in rows for w in words(text.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(map(_word_id, some), pa.binary()), pa.array(some, pa.binary())], ["chunk", "word_id", "word"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The six-grams at the places of each word."""
    for batch in batches:
        if len(batch):
            code, n = codes(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(code.view(np.int64))], ["word_id", "code"])


def _smoothed(n: Column, total: Column, kinds: Column, below: Column) -> Column:
    """Model.discounted of columns; null where a table has no row."""
    return F.when(total > 0, F.greatest(F.coalesce(n, F.lit(0)) - DISCOUNT, F.lit(0.0)) / total + DISCOUNT * kinds / total * below).otherwise(below)


def gram_ratios(wanted: DataFrame, grams: DataFrame, shorter: dict[int, DataFrame]) -> DataFrame:
    """(gram, ratio) of the distinct six-grams in wanted. N-grams that meet in a join differ in one byte, so no key has over 256 rows."""
    context = F.shiftrightunsigned("gram", 8).alias("context")
    needed = {ORDER: wanted.select("gram")}
    for order in range(ORDER - 1, 0, -1):
        needed[order] = staged(needed[order + 1].select(low(F.col("gram"), order).alias("gram")).distinct(), "toxicity-needed")
    below = None
    for order in range(1, ORDER):
        contexts = shorter[order].groupBy(context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = needed[order].select("gram", context, low(F.col("gram"), order - 1).alias("end")).join(shorter[order], "gram", "left").join(contexts, "context", "left")
        rows = rows.join(below, "end") if below else rows.withColumn("below", F.lit(1 / 256))
        p = rows.select(F.col("gram").alias("end"), _smoothed(F.col("n"), F.col("total"), F.col("kinds"), F.col("below")).alias("below"))
        below = staged(p, "toxicity-order")
    sums = [a for c in "01" for a in (F.sum(f"n{c}").alias(f"total{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}"))]
    rows = needed[ORDER].select("gram", context, low(F.col("gram"), ORDER - 1).alias("end")).join(grams, "gram", "left").join(grams.groupBy(context).agg(*sums), "context", "left").join(below, "end")
    ordinary, toxic = (_smoothed(*[F.col(f"{name}{c}") for name in ("n", "total", "kinds")], F.col("below")) for c in "01")
    return rows.select("gram", (F.log(toxic) - F.log(ordinary)).alias("ratio"))


def _score_chunk(rows: pa.Table, found: pa.Table) -> pa.Table:
    by_id = dict(zip(found.column("word_id").to_pylist(), found.column("ratio").to_pylist(), strict=True))
    kept: dict[bytes, float] = {}
    out = []
    for text in rows.column("text"):
        ws = words(text.as_py())
        kept.update((w, by_id[_word_id(w)]) for w in set(ws).difference(kept))
        out.append(features(np.array([kept[w] for w in ws])))
    return pa.Table.from_arrays([rows.column("id"), *[pa.array([f[i] for f in out], pa.float64()) for i in range(3)]], names=["id", "f0", "f1", "f2"])


def measure_by_joins(texts: DataFrame, grams: DataFrame, shorter: dict[int, DataFrame]) -> DataFrame:
    """id and features of every row of texts (id, text), however large the tables. Words are joined by 128 bits of their hash."""
    docs = staged(texts.mapInArrow(_chunked, texts.select("id", "text").schema.add("chunk", "long")), "toxicity-chunks")
    pieces = staged(docs.select("chunk", "text").mapInArrow(_chunk_words, "chunk long, word_id binary, word binary"), "toxicity-words")
    vocabulary = staged(pieces.groupBy("word_id").agg(F.any_value("word").alias("word"), F.count("*").alias("uses")), "toxicity-vocabulary")
    placed = staged(vocabulary.select("word_id", "word").mapInArrow(_placed, "word_id binary, code long"), "toxicity-placed")
    used = staged(placed.groupBy(F.col("code").alias("gram")).agg(F.count("*").alias("places")), "toxicity-used")
    ratios = staged(gram_ratios(used, grams, shorter).join(used, "gram").withColumnRenamed("gram", "code"), "toxicity-ratios")
    of_words = join_counted(placed, ratios, ["code"], "places", placed.count()).groupBy("word_id").agg(F.sum("ratio").alias("ratio"))
    lookup = staged(of_words.join(vocabulary.select("word_id", "uses"), "word_id"), "toxicity-word-ratios")
    found = join_counted(pieces.select("chunk", "word_id"), lookup, ["word_id"], "uses", pieces.count()).select("chunk", "word_id", "ratio")
    schema = texts.select("id").schema.add("f0", "double").add("f1", "double").add("f2", "double")
    return docs.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_score_chunk, schema)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton's method with a little shrinkage; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, score and predicted (score >= THRESHOLD) of every row of docs."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).where("toxic in (0, 1) and id is not null")
    one_in = max(1, known.where(fold(F.col("id")) == 3).count() // FIT_ROWS)
    grams = count(texts, known, one_in)
    totals = grams.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    nothing = texts.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    if not all(totals):
        return nothing
    shorter = continuations(grams)
    if GRAM_BYTES * sum(t.count() for t in (grams, *shorter.values())) <= TABLE_BYTES:
        model = docs.sparkSession.sparkContext.broadcast(Model(grams, shorter))
        schema = texts.select("id").schema.add("f0", "double").add("f1", "double").add("f2", "double")
        measured = staged(texts.select("id", F.col("text").alias("_text")).mapInArrow(_measure(model), schema), "toxicity-features")
        model.unpersist()
    else:
        measured = staged(measure_by_joins(texts, grams, shorter), "toxicity-features")
    fitted = measured.join(known.where(calibrated(one_in)), "id")
    sample = fitted.select("f0", "f1", "f2", F.col("toxic").cast("double")).toArrow().to_pandas().sort_values(["f0", "f1", "f2", "toxic"]).to_numpy()
    if len(set(sample[:, 3])) < 2:
        plain = measured.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-F.col("f0")))).alias("score"))
        return plain.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    centre, spread = sample[:, :3].mean(axis=0), sample[:, :3].std(axis=0) + 1e-9
    w = logistic((sample[:, :3] - centre) / spread, sample[:, 3])
    z = sum(((F.col(f"f{i}") - float(centre[i])) / float(spread[i]) * float(w[i]) for i in range(3)), F.lit(float(w[3])))
    scored = measured.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
