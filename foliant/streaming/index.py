"""A BM25 index that a file stream keeps up to date: new, changed, repeated and deleted documents.

Every batch adds one segment and touches nothing older. A segment has the batch's documents (key, content hash, length),
their terms, the rows of older segments that they replace, and what the batch changes in document frequencies and
totals. Frequencies and mean length are sums over those changes, so no run counts the corpus again; the terms of a
replaced document are read once, to take them out of the frequencies. A batch that runs again after a failure writes over
its own segment and reads only older ones; readers see batches whose last table, ``commits``, is written.

Defined cases: of several versions of a key in one batch the newest file's counts (then the largest path and hash); a
version with the same content as the live one changes nothing; a null text deletes the document; rows with a null key are
left out; an empty text is a document without terms; columns but key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import sparse

DELETED = "deleted"
SCHEMAS = {
    "docs": "{key} {kind}, content_hash string, dl long",
    "words": "{key} {kind}, content_hash string, in_batch long, old_dl long, dl long, terms array<string>, tfs array<long>",
    "replaced": "{key} {kind}, in_batch long",
    "terms": "term string, df long",
    "totals": "n_docs long, n_tokens long",
    "commits": "n_docs long",
}


class SparseIndex:
    """The tables of one index folder."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "long") -> None:
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """All segments of a table that are committed, or all before a batch."""
        schema = SCHEMAS[name].format(key=self.key, kind=self.kind) + ", batch long"
        if before is None:
            before = self.batches()
        if before == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") < before)

    def batches(self) -> int:
        """The number behind the last committed batch, 0 for a new index."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return 0
        last = self.spark.read.schema("n_docs long, batch long").parquet(f"{self.path}/commits").agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def live(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of ``docs`` or ``words`` that no later batch has replaced, or the ``postings`` of the latter."""
        if name == "postings":
            return sparse.each_term(self.live("words", before), self.key)
        old = self.table("replaced", before).select(F.col(self.key).alias("__k"), "in_batch")
        rows = self.table(name, before)
        if name == "words":  # as many rows as documents, so their terms pass the join once
            rows = rows.where(F.col("content_hash") != DELETED).select(self.key, "batch", "dl", "terms", "tfs")
        return rows.join(old, (rows[self.key] == old["__k"]) & (rows["batch"] == old["in_batch"]), "left_anti")

    def term_counts(self) -> DataFrame:
        """(term, df) of the live documents, summed over the batches' changes."""
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """One row: n_docs, total_tokens, avgdl."""
        sums = self.table("totals").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"))
        return sums.select("*", F.try_divide(F.col("total_tokens").cast("double"), F.col("n_docs").cast("double")).alias("avgdl"))

    def search(self, queries: DataFrame, query_key: str, query_text: str = "text", top_k: int = 10, tokenize: Callable[[Column], Column] = sparse.legal_tokenize) -> DataFrame:
        """BM25 over the live documents: query_key, key, score, rank."""
        asked = sparse.asked_terms(queries, query_key, query_text, tokenize)
        return sparse.score_documents(self.live("words"), sparse.weighed_terms(self.term_counts(), self.totals()), self.totals(), asked, self.key, query_key, top_k)

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def add(self, rows: DataFrame, number: int, tokenize: Callable[[Column], Column] = sparse.legal_tokenize) -> None:
        """Adds a batch of (key, text, version): the newest versions replace what the older segments have."""
        key = self.key
        version = F.struct("version", F.sha2("text", 256).alias("hash"))
        newest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("text"), version)["text"].alias("text"))
        hashed = newest.select(key, "text", F.coalesce(F.sha2("text", 256), F.lit(DELETED)).alias("content_hash"))
        before = self.live("docs", number).select(F.col(key).alias("__k"), F.col("content_hash").alias("__h"), F.col("dl").alias("__dl"), F.col("batch").alias("in_batch"))
        met = hashed.join(before, F.col(key) == F.col("__k"), "left").where(~F.col("content_hash").eqNullSafe(F.col("__h")) & ~((F.col("content_hash") == DELETED) & F.col("__k").isNull()))
        made = sparse.document_terms(met.select(F.struct(key, "content_hash", "in_batch", F.col("__dl").alias("old_dl")).alias("row"), "text"), "row", tokenize(F.col("text")))
        self._write(made.select("row.*", "dl", "terms", "tfs"), "words", number)
        changed = self.spark.read.schema(SCHEMAS["words"].format(key=key, kind=self.kind)).parquet(f"{self.path}/words/batch={number}")
        self._write(changed.where(F.col("content_hash") != DELETED).select(key, "content_hash", "dl"), "docs", number)
        gone = changed.where("in_batch is not null").select(key, "in_batch")
        self._write(gone, "replaced", number)
        old = self.table("words", number).select(key, "batch", "terms")
        old = old.join(gone.toDF("__k", "__b"), (F.col(key) == F.col("__k")) & (F.col("batch") == F.col("__b")), "left_semi")
        each = lambda rows, n: rows.select(F.explode("terms").alias("term"), F.lit(n).cast("long").alias("n"))
        steps = each(changed, 1).unionAll(each(old, -1))
        self._write(steps.groupBy("term").agg(F.sum("n").alias("df")).where("df <> 0"), "terms", number)
        more = changed.select(
            (F.when(F.col("content_hash") != DELETED, 1).otherwise(0) - F.when(F.col("in_batch").isNotNull(), 1).otherwise(0)).alias("d"),
            (F.coalesce("dl", F.lit(0)) - F.coalesce("old_dl", F.lit(0))).alias("t"),
        )
        totals = more.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("n_tokens"))
        self._write(totals, "totals", number)
        self._write(totals.select("n_docs"), "commits", number)


def update_index(spark: SparkSession, source: str, target: str, checkpoint: str, key: str = "doc_id", kind: str = "long", text: str = "text", most_files: int | None = None) -> StreamingQuery:
    """Indexes the Parquet files that arrived in ``source`` since the last run, then stops.

    ``most_files`` bounds the files of a batch; by default all that are new are one batch.
    """
    index = SparseIndex(spark, target, key, kind)
    reader = spark.readStream.schema(f"{key} {kind}, {text} string")
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    version = F.struct("_metadata.file_modification_time", "_metadata.file_path")
    stream = reader.parquet(source).select(key, F.col(text).alias("text"), version.alias("version"))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(index.add).start()


def updated_index(spark: SparkSession, source: str, target: str, checkpoint: str, key: str = "doc_id", kind: str = "long", text: str = "text", most_files: int | None = None) -> SparseIndex:
    """Runs the update to its end and returns the index."""
    update_index(spark, source, target, checkpoint, key, kind, text, most_files).awaitTermination()
    return SparseIndex(spark, target, key, kind)
