"""Host-level quality rules, in DataFrame functions only.

Each document's rule failures are added up by host (``source``), each host's failure rates are shrunk with a beta prior
fitted to all hosts (method of moments), and a host whose shrunk rate is above the limit fails as a whole; its verdict
is joined back to its documents.

Defined cases: a null text has no words (and fails the base rule); a document without a host is judged on its own;
repeated rows count each; a host is salted over many tasks; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.shared import stored

WORDS = r"[!-\x{10FFFF}\x00-\x08\x0E-\x1F]+"  # all but blanks and \x09-\x0D; the usual range first, as Java tests them in turn
HOST_LIMIT = 0.5
SALTS = 64
RULES = ("few_words", "repeated_words", "many_symbols", "dup_lines", "word_length")


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts."""
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "source", text.alias("text"), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), has_word)

    def window(w: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), w).alias("h"), i.alias("p"))

    wins = F.transform(F.slice("words", F.lit(3), F.greatest(F.size("words") - 2, F.lit(0))), window)
    counted = split.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.sort_array(wins).alias("wins"),
    )
    same = lambda x, j: F.coalesce(F.get("wins", j)["h"] == x["h"], F.lit(False))
    again = F.filter("wins", lambda x, i: same(x, i - 1) | same(x, i + 1))
    placed = counted.select(
        *["doc_id", "source", "n_words", "word_chars", "n_symbols"],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda x: x["p"])).alias("at"),
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"))
    return placed.select("*", F.aggregate("at", start, step, lambda s: s["n"]).cast("long").alias("n_repeat_words")).drop("at")


def _failures() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * n,
        "many_symbols": 10 * c("n_symbols") > n,
        "dup_lines": c("n_dup_lines") > 5,
        "word_length": (c("word_chars") > 12 * n) | (c("word_chars") < 2 * n),
    }


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """source, host_docs, host_rate (the highest shrunk failure rate of the rules) and host_failed."""
    fails = [F.count_if(f).alias(r) for r, f in _failures().items()]
    hosts = counts.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("host_docs"), *fails)
    # the prior: mean and variance of the hosts' rates, one row
    moments = hosts.agg(
        *[F.avg(F.col(r) / F.col("host_docs")).alias(f"{r}_m") for r in RULES],
        *[F.var_pop(F.col(r) / F.col("host_docs")).alias(f"{r}_v") for r in RULES],
    )
    rate = []
    for r in RULES:
        m, v = F.col(f"{r}_m"), F.greatest(F.col(f"{r}_v"), F.lit(1e-9))
        strength = F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(10_000.0))
        rate.append((F.col(r) + m * strength) / (F.col("host_docs") + strength))
    worst = F.round(F.greatest(*rate), 6)
    return hosts.crossJoin(F.broadcast(moments)).select("source", "host_docs", worst.alias("host_rate"), (worst > limit).alias("host_failed"))


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The counts, base_failed, kept, and the host's rate and verdict for every document."""
    counts = stored(document_counts(docs), "quality")
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    hosts = host_verdicts(counts, limit).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = counts.withColumn("salt", salt).join(hosts.hint("merge"), ["source", "salt"], "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base.alias("base_failed"),
        (~base & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
        "host_rate",
    )


ORACLE = """
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
x as (select r, unnest(range(1, len(w) - 1)) as p, w from d where len(w) > 2),
g as (select r, p, count(*) over (partition by r, w[p], w[p + 1], w[p + 2]) as n from x),
h as (select r, p, p - lag(p) over (partition by r order by p) as gap from g where n > 1),
q as (select r, sum(least(3, coalesce(gap, 3)))::bigint as n_repeat_words from h group by r),
l as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
c as (
  select d.doc_id, d.source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d join l using (r) left join q using (r)),
s as (select source, count(*)::double as n, count(*) filter (n_words < 50)::double as a, count(*) filter (100 * n_repeat_words > 50 * n_words)::double as b,
    count(*) filter (10 * n_symbols > n_words)::double as e, count(*) filter (n_dup_lines > 5)::double as f,
    count(*) filter (word_chars > 12 * n_words or word_chars < 2 * n_words)::double as g
  from c where source is not null group by source),
u as (unpivot s on a, b, e, f, g into name rule value fails),
m as (select rule, avg(fails / n) as mean, greatest(var_pop(fails / n), 1e-9) as var from u group by rule),
k as (select rule, mean, least(greatest(mean * (1 - mean) / var - 1, 1.0), 10000.0) as strength from m),
v as (select source, round(max((fails + mean * strength) / (n + strength)), 6) as host_rate from u join k using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(host_rate > 0.5, false) as kept, host_rate
from c left join v using (source)
"""
