"""Data rooms: scans, inventories, discovery, stored indexes and graphs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions and their MIME types.
SUPPORTED = (".pdf", ".docx", ".doc", ".txt", ".md", ".xls", ".xlsx", ".ppt", ".pptx")
MIME = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".txt": "text/plain",
    ".md": "text/markdown",
}
TABLES = {"vectors", "postings", "checklist", "questions", "nodes", "edges"}


def scan_data_room(spark: SparkSession, root: str, glob: str = "*.{txt,md}") -> DataFrame:
    """source, path (below the root), name, text of all text files; a missing root fails."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("source"), F.decode("content", "UTF-8").alias("text"))
    path = F.substring("source", len(re.sub(r"^file:/+", "/", root).rstrip("/")) + 2, 10_000)
    return base.select("source", path.alias("path"), F.element_at(F.split("source", "/"), -1).alias("name"), "text")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def file_inventory(files: DataFrame) -> DataFrame:
    """Supported files with their size as text."""
    return files.where(extension(F.col("name")).isin(*SUPPORTED)).select("path", "name", F.col("size"), F.format_number("size", 0).alias("size_text"))


def room_slug(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("-")))


def discover_stores(files: DataFrame) -> DataFrame:
    """Projects and rooms with at least one supported file."""
    kept = files.where(extension(F.col("name")).isin(*SUPPORTED))
    return kept.groupBy("project", "room").agg(F.count("*").alias("n_files")).withColumn("slug", room_slug(F.col("room")))


def count_by_type(files: DataFrame) -> DataFrame:
    ok = extension(F.col("name")).isin(*SUPPORTED)
    return files.agg(F.count_if(ok).alias("documents"), F.count_if(~ok).alias("unsupported"), F.count_distinct("project").alias("projects"), F.count_distinct("project", "room").alias("rooms"))


def has_supported_files(rooms: DataFrame, files: DataFrame) -> DataFrame:
    """Rooms that hold a supported file."""
    return rooms.join(files.where(extension(F.col("name")).isin(*SUPPORTED)), ["project", "room"], "left_semi")


def missing_index(stores: DataFrame, indexed: DataFrame, key: str = "room") -> DataFrame:
    return stores.join(indexed.select(key), key, "left_anti")


def project_catalog(files: DataFrame) -> DataFrame:
    """Projects with their rooms and documents."""
    return discover_stores(files).groupBy("project").agg(F.count("*").alias("n_rooms"), F.sum("n_files").alias("n_documents"))


def chunks_from_store(chunks: DataFrame, n: int = 500) -> DataFrame:
    return chunks.withColumn("text", F.when(F.length("text") > n, F.concat(F.substring("text", 1, n), F.lit("..."))).otherwise(F.col("text")))


def mime_type(name: Column) -> Column:
    out = None
    for ext, mime in MIME.items():
        out = F.when(extension(name) == ext, mime) if out is None else out.when(extension(name) == ext, mime)
    return out.otherwise("application/octet-stream")


def document_title(name: Column) -> Column:
    """Without extension, blanks for ``_`` and ``-``, words capitalised (after blanks only)."""
    return F.initcap(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """file, text of markdown files, each as one row."""
    text = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


CHECKLIST_JSON = "map<string, struct<name: string, items: array<struct<text: string, original: string>>>>"
QUESTIONS_JSON = "map<string, array<struct<category: string, question: string, id: string>>>"


def nested_checklists(checklist: DataFrame) -> DataFrame:
    """(file, json): flat rows (file, letter, category, item_no, text, original) as one nested map per file."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("item_no", "text", "original"))), lambda i: F.struct(i["text"].alias("text"), i["original"].alias("original")))
    letters = checklist.groupBy("file", "letter").agg(F.min("category").alias("name"), items.alias("items"))
    whole = letters.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", F.struct("name", "items"))))).alias("m"))
    return whole.select("file", F.to_json("m").alias("json"))


def flat_checklists(nested: DataFrame) -> DataFrame:
    """(file, json) -> file, letter, category, item_no (from 1), text, original; json that is none gives no row."""
    letters = nested.select("file", F.explode(F.from_json("json", CHECKLIST_JSON)).alias("letter", "c"))
    items = letters.select("file", "letter", F.col("c.name").alias("category"), F.posexplode("c.items").alias("i", "item"))
    return items.select("file", "letter", "category", (F.col("i") + 1).alias("item_no"), "item.text", F.coalesce("item.original", "item.text").alias("original"))


def flat_questions(nested: DataFrame) -> DataFrame:
    """(json) of questions by file -> file, id, category, question."""
    files = nested.select(F.explode(F.from_json("json", QUESTIONS_JSON)).alias("file", "q"))
    return files.select("file", F.explode("q").alias("q")).select("file", "q.id", "q.category", "q.question")


def write_texts(files: DataFrame, path: str) -> None:
    """A sink of one committed text file per row of (file, text): ``{path}/file={file}/part-…``; a null text is an empty file.

    Rows are dealt by file name, so a name is written by one task; repeated names become one file, texts in order.
    """
    one = files.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("text", F.lit("")))), "\n").alias("text"))
    one.repartition("file").write.partitionBy("file").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of what ``write_texts`` wrote."""
    rows = spark.read.schema("value string, file string").text(path, wholetext=True)
    return rows.select("file", F.when(F.endswith("value", F.lit("\n")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("text"))


def save_store(df: DataFrame, path: str) -> None:
    """Writes index rows by store; stores that the rows do not name stay as they are."""
    df.write.partitionBy("store").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_prebuilt(spark: SparkSession, path: str, file: str) -> DataFrame:
    """The rows of one stored structure; an unknown name fails and names what there is."""
    table = spark.read.parquet(path)
    rows = table.where(F.col("file") == file)
    if rows.isEmpty():
        raise ValueError(f"no {file}; there are {[r[0] for r in table.select('file').distinct().orderBy('file').limit(50).collect()]}")
    return rows


def save_graph(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("metadata", metadata)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def list_graphs(edges: DataFrame) -> DataFrame:
    return edges.select("store").distinct()


#: Readers by content type: name -> (spark, path) -> rows; callers may add their own.
READERS = {"rooms": scan_data_room, "markdown": read_markdown, "texts": read_texts, "parquet": lambda spark, path: spark.read.parquet(path)}
