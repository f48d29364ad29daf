"""The pipeline's stages on a small table: order, columns, effect."""

import corpus_pipeline
from foliant.functions.shared import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "token_output"]
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        n = docs.count()
        assert 0 < n <= (2 if name == "mixing" else 1) * before
        before = n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == before and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def odd_documents(spark, sf):
    """Given documents, and nulls in any column, empty and long texts, repeated rows, and columns with clashing names."""
    given = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = [
        (9001, None, "en", "src1", 0),
        (9002, "", None, None, None),
        (None, "a text without an id stands here alone", "en", "src1", 5),
        (9003, "word " * 60_000, "en", "src2", 300_000),
        (9004, "twice the same row of quite some words", "de", "src1", 40),
        (9004, "twice the same row of quite some words", "de", "src1", 40),
        (9005, " \t\n ", "en", "src3", 4),
    ]
    docs = given.unionByName(spark.createDataFrame(odd, given.schema))
    return docs.selectExpr("*", "1 as key", "'x' as doc", "2 as id", "doc_id as `a.b`")


def test_stages_take_odd_rows(spark, sf):
    docs = stored(odd_documents(spark, sf), "odd")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ids = [r[0] for r in docs.select("doc_id").collect()]
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        left = [r[0] for r in docs.select("doc_id").collect()]
        assert set(left) <= set(ids)
        if name == "toxicity":
            assert {9001, 9002, 9003, 9004, 9005, None} <= set(left)
        if name == "ngram_join":
            assert left.count(9004) == 1 and {9001, 9002, 9005, None} <= set(left)
        if name == "decontamination":
            assert {9001, 9002, 9003, 9004, 9005, None} <= set(left)
        if name == "mixing":
            assert not {9001, 9002, 9005} & set(left)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == docs.count() and all(r.n_tokens >= 1 for r in out)


def test_stages_take_empty_tables(spark, sf):
    docs = stored(spark.read.parquet(f"{sf}/documents.parquet").where("false"), "none")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.count() == 0
