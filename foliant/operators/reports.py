"""Insights, citations, exports and run reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.text import literal, replaced_once, truncate_text


def qa_insights(answers: DataFrame) -> DataFrame:
    return answers.where("has_answer").select("question_id", F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), truncate_text(F.col("sources"), 200)).alias("insight"))


def analysis_corpus(**parts: DataFrame) -> DataFrame:
    """Rows (name, text) of several kinds under one type column."""
    out = None
    for kind, df in parts.items():
        part = df.select(F.lit(kind).alias("type"), F.col("name").cast("string").alias("name"), "text")
        out = part if out is None else out.unionByName(part)
    return out


def context_focus(sections: DataFrame, focuses: DataFrame) -> DataFrame:
    """Sections whose word stands in the focus, joined by section order: focus, context."""
    hit = focuses.join(F.broadcast(sections), F.contains(F.lower("focus"), F.col("word")))  # sections: a handful of rows
    return hit.groupBy("focus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("context"))


def prompt_table(docs: DataFrame, templates: DataFrame, name: str, text: str, n: int = 1000) -> DataFrame:
    """A prompt per document and template; templates (kind, template) hold ``{name}`` and ``{text}``: a handful of rows."""
    filled = F.replace(F.replace(F.col("template"), F.lit("{name}"), F.col(name)), F.lit("{text}"), truncate_text(F.col(text), n))
    return docs.select(name, text).crossJoin(F.broadcast(templates)).select(name, "kind", filled.alias("prompt"))


def citations(mentions: DataFrame, top: int = 2) -> DataFrame:
    """Per report and document one numbered citation in first-seen order: distinct excerpts (best two) and relevance.

    mentions: (report, doc, ord, excerpt, relevance)
    """
    best = mentions.groupBy("report", "doc", "excerpt").agg(F.min("ord").alias("ord"), F.max("relevance").alias("relevance"))
    docs = best.groupBy("report", "doc").agg(F.min("ord").alias("first_ord"), F.round(F.max("relevance"), 6).alias("relevance"), F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "ord", "excerpt"))).alias("e"))
    number = F.row_number().over(Window.partitionBy("report").orderBy("first_ord", "doc"))
    return docs.select("report", number.alias("number"), "doc", "relevance", F.array_join(F.transform(F.slice("e", 1, top), lambda x: x["excerpt"]), " … ").alias("excerpts"))


def citation_id(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(10000))


def inline_citations(reports: DataFrame, names: DataFrame) -> DataFrame:
    """``{name}`` in a report becomes ``according to **Clean Name**``, in one pass.

    names: (report, name); the clean name has no extension and blanks for underscores.
    """
    clean = F.concat(F.lit("according to **"), F.initcap(F.translate(F.regexp_replace("name", r"\.[^.]*$", ""), "_-", "  ")), F.lit("**"))
    listed = names.where("name is not null").select("report", F.struct("name", clean.alias("put")).alias("n")).groupBy("report").agg(F.array_sort(F.collect_set("n")).alias("__n"))
    pattern = F.concat(F.lit(r"\{(?:"), F.array_join(F.transform("__n", lambda n: literal(n["name"])), "|"), F.lit(r")\}"))
    known = listed.select("report", pattern.alias("__p"), F.map_from_entries("__n").alias("__m"))
    joined = reports.join(known.hint("merge"), "report", "left")
    put = replaced_once(F.col("text"), F.col("__p"), lambda m: F.try_element_at("__m", F.substring(m, F.lit(2), F.length(m) - 2)))
    return joined.select("report", F.when(F.col("__p").isNull(), F.col("text")).otherwise(put).alias("text"))


def paragraph_mentions(reports: DataFrame, names: DataFrame) -> DataFrame:
    """report, paragraph, name: the names of the report's own list that a paragraph holds."""
    parts = reports.select("report", F.posexplode(F.split("text", "\n\n", -1)).alias("paragraph", "part"))
    return parts.join(names.select("report", "name").distinct().hint("merge"), "report").where(F.contains(F.lower("part"), F.lower("name"))).select("report", "paragraph", "name")


def citation_counts(cited: DataFrame, tool: str) -> DataFrame:
    """Citations and distinct documents per tool and in total."""
    n = cited.rollup(tool).agg(F.count("*").alias("n_citations"), F.count_distinct("doc").alias("n_docs"))
    return n.select(F.coalesce(F.col(tool), F.lit("total")).alias("tool"), "n_citations", "n_docs")


def resolve_paths(wanted: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """The first root under which a wanted relative path exists, else a file of that name: wanted, path.

    Both tries are equi-joins; the choice is by priority.
    """
    tries = wanted.select("wanted", F.posexplode(F.array(*[F.concat(F.lit(r), F.col("wanted")) for r in roots])).alias("priority", "path"))
    found = tries.join(files.select("path").hint("merge"), "path", "left_semi").select("wanted", "priority", "path")
    base = F.element_at(F.split("wanted", "/"), -1)
    named = wanted.select("wanted", base.alias("name")).join(files.select("name", "path").hint("merge"), "name").select("wanted", F.lit(len(roots)).alias("priority"), "path")
    best = found.unionByName(named).groupBy("wanted").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return wanted.select("wanted").distinct().join(best.hint("merge"), "wanted", "left")


def export_reports(sections: DataFrame) -> DataFrame:
    """One markdown text per company from ordered sections (company, ord, title, body), with its file name."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"))
    joined = sections.select("company", "ord", part.alias("part")).groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n\n").alias("__b"))
    slug = F.lower(F.replace("company", F.lit(" "), F.lit("-")))
    return joined.select("company", F.concat(slug, F.lit("-report.md")).alias("file"), F.concat(F.lit("# "), F.col("company"), F.lit("\n\n"), F.col("__b")).alias("markdown"))


def build_report(log: DataFrame) -> DataFrame:
    """Events per status with their share, and in total."""
    by = log.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")
    total = log.agg(F.count("*").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.try_divide(100.0 * F.col("n"), F.col("t")), 4).alias("percent"))


def stage_status(log: DataFrame) -> DataFrame:
    """The latest status and time of each stage, and how often it ran."""
    return log.groupBy("stage").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("last_run"), F.count("*").alias("n_runs"))


def expire_results(results: DataFrame, at: Column, days: int) -> DataFrame:
    """Results not older than so many days at a time."""
    return results.where(F.col("ts") > at - F.expr(f"interval {days} days"))
