"""The registered queries of the training-data operators, each over its whole table, and SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, langid, licenses, lines, minhash, mixing, packing, topk, toxicity
from .common import LOWER, UPPER, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT r.id, l.v FROM reach r JOIN links l ON r.other = l.u
), named AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN named c ON c.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


OP2_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= 0.95 * a.norm * b.norm
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM vectors
  UNION
  SELECT r.id, l.v FROM reach r JOIN links l ON r.other = l.u
), named AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
), counted AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, n.component_id, coalesce(v.vec_id = n.component_id, true) AS kept
FROM vectors v LEFT JOIN named n ON n.id = v.vec_id LEFT JOIN counted c ON c.u = v.vec_id
"""


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM numbered
), often AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def vocabulary() -> dict[str, str]:
    """The installed public vocabulary; the operator takes any."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **vocabulary())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix(table(spark, sf_dir, "documents"))
    rows = units.select("*", F.explode(F.array_repeat(F.lit(1), F.col("m").cast("int"))).alias("row"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


OP9_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 20
"""

def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations")).withColumn("sha256", F.sha2("rendered", 256))


OP10_SQL = """
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations
), turns AS (
  SELECT conv_id, place,
         sha256(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')) AS h,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' AS line
  FROM placed
), prefixes AS (
  SELECT conv_id, place, string_agg(h, '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), hashed AS (
  SELECT conv_id, place, sha256(prefix) AS p, n FROM prefixes
), wholes AS (
  SELECT p, place AS n_turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM hashed WHERE place = n GROUP BY ALL
), stay AS (
  SELECT * FROM wholes WHERE (p, n_turns) NOT IN (SELECT p, place FROM hashed WHERE place < n)
), rendered AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS rendered FROM turns GROUP BY conv_id
)
SELECT s.conv_id, s.n_turns, s.n_equal, r.rendered, sha256(r.rendered) AS sha256
FROM stay s JOIN rendered r ON s.conv_id IS NOT DISTINCT FROM r.conv_id
"""

QUERIES = {"op1_minhash": op1_minhash, "op2_embeddings": op2_embeddings, "op3_lines": op3_lines, "op4_licenses": op4_licenses, "op5_langid": op5_langid, "op6_toxicity": op6_toxicity, "op7_packing": op7_packing, "op8_mixing": op8_mixing, "op9_topk": op9_topk, "op10_chat": op10_chat}

ORACLE: dict[str, str] = {"op1_minhash": OP1_SQL, "op2_embeddings": OP2_SQL, "op3_lines": OP3_SQL, "op9_topk": OP9_SQL, "op10_chat": OP10_SQL}
