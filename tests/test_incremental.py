"""The streamed index and the streamed expiry."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import sparse
from foliant.streaming.expiry import ROCKSDB, expired_results
from foliant.streaming.index import SparseIndex, updated_index


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def check_against_rebuild(spark, index, final):
    """The index has the postings, frequencies, totals and hits of an index of ``final`` ({key: text})."""
    docs = spark.createDataFrame(list(final.items()), "doc_id long, text string")
    fresh = sparse.postings(docs, "doc_id")
    assert rows_of(index.live("postings").select("doc_id", "term", "tf", "dl")) == rows_of(fresh.select("doc_id", "term", "tf", "dl"))
    assert rows_of(index.term_counts()) == rows_of(fresh.groupBy("term").count())
    assert rows_of(index.live("docs").select("doc_id")) == [(k,) for k in sorted(final)]
    have, want = index.totals().first(), sparse.corpus_stats(docs, "doc_id").first()
    assert (have.n_docs, have.total_tokens) == (want.n_docs, want.total_tokens or 0)
    if final:
        asked = spark.createDataFrame([(1, "alpha beta closing"), (2, "gamma gamma terms")], "q long, text string")
        assert rows_of(index.search(asked, "q")) == rows_of(sparse.bm25_search(docs, asked, "doc_id", "q"))


def put(spark, folder, rows):
    time.sleep(0.02)  # files of later batches are newer
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)


def test_changed_repeated_and_deleted_documents(spark, tmp_path):
    folder, target, mark = (str(tmp_path / n) for n in ("in", "index", "mark"))
    put(spark, folder, [(1, "alpha beta"), (2, "beta gamma gamma"), (3, "Alpha_alpha delta"), (None, "no key"), (4, ""), (9, None)])
    index = updated_index(spark, folder, target, mark)
    final = {1: "alpha beta", 2: "beta gamma gamma", 3: "Alpha_alpha delta", 4: ""}
    check_against_rebuild(spark, index, final)
    put(spark, folder, [(2, "gamma closing"), (1, "alpha beta"), (5, "closing terms"), (4, "terms terms")])  # changed, repeated, new
    index = updated_index(spark, folder, target, mark)
    final |= {2: "gamma closing", 5: "closing terms", 4: "terms terms"}
    check_against_rebuild(spark, index, final)
    assert index.live("docs").where("doc_id = 1").first().batch == 0  # what is unchanged stays where it is
    put(spark, folder, [(2, "beta gamma gamma"), (3, None), (8, None), (5, "closing terms now")])  # back to the first, deleted, never seen
    put(spark, folder, [(5, "the newest terms")])  # two versions in one batch
    index = updated_index(spark, folder, target, mark)
    final |= {2: "beta gamma gamma", 5: "the newest terms"}
    del final[3]
    check_against_rebuild(spark, index, final)
    assert index.batches() == 3
    # a batch that runs again replaces its own segment
    again = spark.createDataFrame([(5, "the newest terms", 9), (2, "beta gamma gamma", 9), (3, None, 9), (8, None, 9)], "doc_id long, text string, version int")
    index.add(again, 2)
    check_against_rebuild(spark, index, final)
    put(spark, folder, [(k, None) for k in (1, 2, 4, 5)])
    check_against_rebuild(spark, updated_index(spark, folder, target, mark), {})


def test_a_new_index_is_empty(spark, tmp_path):
    index = SparseIndex(spark, str(tmp_path / "none"))
    assert index.batches() == 0 and index.live("postings").count() == 0
    asked = spark.createDataFrame([(1, "alpha")], "q long, text string")
    assert index.search(asked, "q").count() == 0


def test_files_one_by_one(spark, tmp_path):
    folder, target, mark = (str(tmp_path / n) for n in ("in", "index", "mark"))
    for text in ("alpha", "alpha beta", "beta"):
        put(spark, folder, [(1, text), (2, f"{text} closing")])
    index = updated_index(spark, folder, target, mark, most_files=1)
    assert index.batches() >= 3
    check_against_rebuild(spark, index, {1: "beta", 2: "beta closing"})


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_one_result_expires_and_one_stays(spark, tmp_path, state_store):
    folder, mark, out = (str(tmp_path / n) for n in ("in", "mark", "out"))
    schema = "key string, result string, created_at timestamp"
    day = lambda d: datetime(2024, 1, d)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = expired_results(spark.readStream.schema(schema).parquet(folder), 7)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).outputMode("update").foreachBatch(write).start().awaitTermination()
        return rows_of(spark.read.schema("key string, result string").parquet(out).select("key", "result"))

    assert run([("a", "one", day(1)), ("b", "two", day(1)), (None, "x", day(1)), ("c", "x", None)]) == []
    assert run([("b", "newer", day(6)), ("d", "four", day(10))]) == [("a", "one")]  # b began again on day 6
    assert run([("d", "older", day(9)), ("e", "five", day(16))]) == [("a", "one"), ("b", "newer")]  # d is of day 10
    assert spark.read.schema("key string, expired_at timestamp").parquet(out).where("key = 'b'").select(F.date_format("expired_at", "yyyy-MM-dd")).first()[0] == "2024-01-13"
