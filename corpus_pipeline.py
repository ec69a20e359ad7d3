"""From documents to packed sequences: STAGES in order, each over all rows that its predecessor kept.

Each function takes (spark, docs, sf_dir); all but the last return the columns of documents. The pipeline's rows can't be
stated in SQL, as it learns a network and draws; tests hold its stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootstone.llm import langid, lines, minhash, mixing, packing
from rootstone.llm.common import staged, table
from rootstone.llm.queries import vocabulary

#: Texts whose best language is less than so many times likelier than the next are rejected, besides those without a letter, however many
#: languages are known.
LEAST_LEAD = 1.05
#: Lines in so many documents stay in the first of them only.
LINE_DOCS = 10
#: Words of a shingle; documents are near duplicates from a similarity of 0.8.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network knows; rejects those without a letter and those between languages. Where nothing can be
    learnt, as no document is labelled, all documents stay."""
    network = langid.fit(docs)
    if network is None:
        return docs
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # its names cannot clash with those added
    found = langid.identify(rows, network, ["row"], "row.text")
    return found.where((F.col("lang_pred") != "und") & (F.col("lead") >= LEAST_LEAD)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the first occurrence of lines that many documents share; n_chars follows the text."""
    kept = lines.drop_repeated(docs, min_docs=LINE_DOCS, first=True, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the least id stays. Rows that repeat an id are one document with several texts: it
    stays or goes as a whole, and of its rows with one text any one stays. Rows without an id stay."""
    gone = minhash.near_duplicates(docs, width=SHINGLE).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # their names cannot clash with others
    left = rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti")
    known = left.where("row.doc_id is not null").groupBy(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("h"), F.hash("row.text").alias("g"))
    return known.agg(F.any_value("row").alias("row")).select("row.*").unionByName(left.where("row.doc_id is null").select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows equal in id, source and size are taken equally often; other columns are passed on."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; copies of a document are packed each by itself."""
    return packing.pack(docs, **vocabulary())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
