"""Registered queries against their SQL on the small tables, and the pipeline's stages against plain Python."""

import os
import zlib

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "labels"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def test_against_sql(spark, duck):
    from rootstone.llm.queries import ORACLE, QUERIES

    for name, statement in ORACLE.items():
        got, want = QUERIES[name](spark, SF), duck.sql(statement)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda all_: sorted(tuple(map(str, r)) for r in all_)
        assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall()), name


def test_columns_of_the_rest(spark):
    from rootstone.llm.queries import ORACLE, QUERIES

    wanted = {
        "op4_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op5_langid": ["doc_id", "held_out", "lang_pred", "score"],
        "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    }
    assert wanted.keys() == QUERIES.keys() - ORACLE.keys()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in wanted.items():
        rows = QUERIES[name](spark, SF)
        assert rows.columns[: len(columns)] == columns
        assert rows.count() >= n
    held = {r.doc_id: r.held_out for r in QUERIES["op5_langid"](spark, SF).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in held.items())


def test_pipeline_against_brute_force(spark, tmp_path):
    from test_lines import brute as dedup
    from test_minhash import brute as families
    from test_packing import check, ids_of

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(900_000 + k, t, "en", "src1", len(t)) for k, t in enumerate(["12 34", "!!", "repeated line\nown " + "x" * 9] + [f"repeated line\nown words of document {k} that nobody shares {k * 7}" for k in range(12)])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        after = stage(spark, before, SF)
        after.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = (before.collect(), docs.collect())
        if name != "pack":
            assert docs.columns == columns
    before, after = kept["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {900_000, 900_001}
    before, after = kept["line_dedup"]
    want = {i: text for i, _, _, text in dedup(sorted((r.doc_id, r.text) for r in before), corpus_pipeline.LINE_DOCS, True)}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    assert sum("repeated line" in t for t in want.values()) == 1
    before, after = kept["near_dedup"]
    root = families([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(set(root.values())) and len(after) < len(before)
    before, after = kept["mix"]
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)
    words, taken = sum(len((r.text or "").split()) for r in before), sum(len((r.text or "").split()) for r in after)
    assert abs(words - taken) <= 0.1 * words
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    _, packed = kept["pack"]
    once = [r for r in packed if copies[r.doc_id] == 1]
    ids = {i: ids_of(texts[i]) for i in copies}
    assert sum(r.length for r in packed) == sum(len(ids[i]) * n for i, n in copies.items())
    assert {r.doc_id for r in once} == {i for i, n in copies.items() if n == 1}
    by_doc = {}
    for r in once:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == len(ids[i])
        for r in pieces:
            assert zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert check.__doc__ is None
