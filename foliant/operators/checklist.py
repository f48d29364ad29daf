"""Checklists and questions: parsing, matching with adaptive thresholds, roll-ups and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shared import global_rank
from foliant.operators.text import normalise_key, truncate_text

RELEVANCY, POOL, MULTIPLIER, LEAST_CANDIDATES, LEAST_STD = 0.25, 30, 1.5, 5, 0.05


def _lines(files: DataFrame) -> DataFrame:
    """file, line_no, line (trimmed) of texts in (file, text)."""
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).select("file", "line_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))


def _is_item(text: Column) -> Column:
    return (F.length(text) > 10) & ~((text == F.upper(text)) & (text != F.lower(text)))


def parse_numbered_items(files: DataFrame) -> DataFrame:
    """Numbered lines without their number, longer than 10 characters and not all upper case."""
    item = F.regexp_replace("line", r"^\d+\.\s+", "")
    return _lines(files).where(F.col("line").rlike(r"^\d+\.\s+")).select("file", "line_no", item.alias("text")).where(_is_item(F.col("text")))


def parse_list_items(files: DataFrame) -> DataFrame:
    """As numbered items, also bullets; heading and rule lines are left out."""
    lines = _lines(files).where(~F.col("line").startswith("#") & ~F.col("line").startswith("⸻"))
    item = F.regexp_replace("line", r"^(\d+\.|-)\s+", "")
    return lines.where(F.col("line").rlike(r"^(\d+\.|-)\s+")).select("file", "line_no", item.alias("text")).where(_is_item(F.col("text")))


def parse_checklist(files: DataFrame) -> DataFrame:
    """file, letter, category, item_no, text, original: lettered headings carried down to their numbered lines."""
    head = r"^#*\s*([A-Z])\.\s+(.+)$"
    is_head = F.col("line").rlike(head)
    marked = _lines(files).select("*", *[F.when(is_head, F.regexp_extract("line", head, g)).alias(n) for g, n in ((1, "h"), (2, "c"))])
    down = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.select("file", "line_no", "line", F.last("h", True).over(down).alias("letter"), F.last("c", True).over(down).alias("category"))
    clean = lambda c: F.trim(F.replace(normalise_quotes(c), F.lit("\\&"), F.lit("&")))
    items = carried.where(F.col("line").rlike(r"^\d+\.\s+\S") & F.col("letter").isNotNull())
    number = F.row_number().over(Window.partitionBy("file", "letter").orderBy("line_no"))
    return items.select("file", "letter", clean(F.regexp_replace("category", r"\*+", "")).alias("category"), number.alias("item_no"), clean(F.regexp_replace("line", r"^\d+\.\s+", "")).alias("text"), F.col("line").alias("original"))


def normalise_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def parse_questions(files: DataFrame) -> DataFrame:
    """file, id (letter.number), category, question."""
    return parse_checklist(files).select("file", F.concat_ws(".", "letter", "item_no").alias("id"), "category", F.col("text").alias("question"))


def valid_items(items: DataFrame) -> DataFrame:
    """Items with text; ``original`` defaults to the text. Categories without items fall away."""
    return items.where(F.trim("text") != "").withColumn("original", F.coalesce("original", "text"))


def question_document(questions: DataFrame) -> DataFrame:
    return questions.withColumn("document", F.concat_ws(": ", "category", "question"))


def distinct_keys(texts: DataFrame, text: str, known: DataFrame, key: str = "key") -> DataFrame:
    """Normalised keys that have no stored vector yet, each once."""
    return texts.select(normalise_key(F.col(text)).alias(key)).where(F.col(key) != "").distinct().join(known.select(key).hint("merge"), key, "left_anti")


def significant_matches(matches: DataFrame, item: str = "item_no", multiplier: float = MULTIPLIER) -> DataFrame:
    """Keeps scores of at least mean + m * max(std, floor) of their item; items with few candidates keep all."""
    w = Window.partitionBy(item)
    full = matches.select("*", F.count("*").over(w).alias("n_candidates"), F.avg("score").over(w).alias("mean"), F.greatest(F.stddev_pop("score").over(w), F.lit(LEAST_STD)).alias("std"))
    few = F.col("n_candidates") < LEAST_CANDIDATES
    limit = F.when(few, F.lit(0.0)).otherwise(F.round(F.col("mean") + multiplier * F.col("std"), 6))
    method = F.when(few, "insufficient_data").otherwise("statistical")
    kept = full.select(*matches.columns, "n_candidates", limit.alias("threshold"), method.alias("method"))
    return kept.where((F.col("method") == "insufficient_data") | (F.col("score") >= F.col("threshold")))


def match_statistics(matches: DataFrame, item: str = "item_no") -> DataFrame:
    r = lambda c: F.round(c, 6)
    return matches.groupBy(item).agg(F.count("*").alias("n"), r(F.avg("score")).alias("mean"), r(F.stddev_pop("score")).alias("std"), r(F.min("score")).alias("low"), r(F.max("score")).alias("high"))


def match_checklist(scores: DataFrame, pool: int = POOL, item: str = "item_no", doc: str = "vec_id") -> DataFrame:
    """Cosine scores per item -> rounded, the best ``pool``, those that stand out."""
    rounded = scores.withColumn("score", F.round("score", 3))
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), doc))
    return significant_matches(rounded.withColumn("rank", rank).where(F.col("rank") <= pool), item)


def category_rollup(checklist: DataFrame, matches: DataFrame, item: str = "item_no") -> DataFrame:
    """letter, category, total_items, matched_items."""
    n = matches.groupBy(item).agg(F.count("*").alias("n"))
    return checklist.join(n.hint("merge"), item, "left").groupBy("letter", "category").agg(F.count("*").alias("total_items"), F.count_if(F.col("n") > 0).alias("matched_items"))


def display_filter(checklist: DataFrame, matches: DataFrame, relevancy: float = RELEVANCY, item: str = "item_no") -> DataFrame:
    shown = matches.where(F.col("score") >= relevancy).groupBy(item).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return checklist.join(shown.hint("merge"), item, "left").select(item, "text", n.alias("n_shown"), F.when(n > 0, "✅").otherwise("❌").alias("mark"), F.concat(n, F.when(n == 1, F.lit(" document")).otherwise(" documents")).alias("label"))


def answer_questions(questions: DataFrame, hits: DataFrame, threshold: float, key: str, top: int = 5) -> DataFrame:
    """Sources (best first, joined) and has_answer for every question."""
    good = hits.where((F.col("rank") <= top) & (F.col("score") >= threshold))
    listed = good.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "; ").alias("sources"), F.count("*").alias("n_sources"))
    return questions.join(listed.hint("merge"), key, "left").select(key, F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.col("n_sources").isNotNull().alias("has_answer"))


def keyed_results(rows: DataFrame, order: list[str], prefix: str = "result") -> DataFrame:
    """Adds ``key``: the prefix and a row's number from 0 in the order, without one task seeing all rows."""
    return global_rank(rows, [F.col(c) for c in order], "__n").withColumn("key", F.concat(F.lit(f"{prefix}_"), "__n")).drop("__n")


def rag_context(hits: DataFrame, key: str, threshold: float, top: int = 5, n: int = 200) -> DataFrame:
    """The lines ``- name: text...`` of the best hits, in order, and the prompt they go into."""
    good = hits.where((F.col("rank") <= top) & (F.col("score") >= threshold))
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.substring("text", 1, n), F.lit("..."))
    joined = good.select(key, "rank", line.alias("line")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))
    return joined.withColumn("prompt", F.format_string("Context:\n%s\n\nAnswer the question %s.", F.col("context"), F.col(key).cast("string")))


def context_documents(docs: DataFrame, key: str, name: str, text: str, most: int = 5, n: int = 1000) -> DataFrame:
    """The first documents of each key, cut, under a header line each, joined."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(name))
    part = F.concat(F.lit("## "), F.col(name), F.lit("\n"), truncate_text(F.col(text), n))
    first = docs.select(key, name, text).withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", part.alias("part"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def completion(total: Column, matched: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * matched, total), F.lit(0.0))


def compliance_tier(percent: Column) -> Column:
    return F.when(percent > 80, "strong compliance").when(percent > 50, "moderate compliance").otherwise("gaps")


def checklist_insights(rollup: DataFrame) -> DataFrame:
    percent = F.round(completion(F.col("total_items"), F.col("matched_items")), 1)
    text = F.concat(F.col("category"), F.lit(": "), F.col("matched_items"), F.lit(" of "), F.col("total_items"), F.lit(" items matched, "), compliance_tier(percent))
    return rollup.select("letter", percent.alias("percent"), compliance_tier(percent).alias("tier"), text.alias("insight"))
