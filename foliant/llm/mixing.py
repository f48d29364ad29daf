"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / w`` (u from a hash of the row, w its quality weight). Sources get
token targets; whole epochs of a source come first, and the rest of its target is filled by the documents with the
smallest keys, along a prefix sum. The prefix sum is taken in two levels (key buckets, then inside a bucket), so a
source with any share of all rows is spread over many tasks.

Defined cases: a text without words, null or not, has size 0 and is never taken, though ``mix`` counts its epochs; a null source is a source of its own, last in order; rows with
equal keys are ordered by doc_id, repeated rows are interchangeable; an empty table gives no row; other columns are
ignored by ``mix`` and carried by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shared import boxed, global_rank, stored

WORDS = r"[!-\x{10FFFF}\x00-\x08\x0E-\x1F]+"  # all but blanks and \x09-\x0D; the usual range first, as Java tests them in turn
SOURCE_WEIGHTS = (5, 2, 1)
BUCKETS = 1024


def quality_weight(size: Column, text: Column) -> Column:
    """Default document weight from quality rules: less for few words, many symbols and repeated lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("double") / F.greatest(size, F.lit(1))
    repeated = (F.size(lines) - F.size(F.array_distinct(lines))).cast("double") / F.size(lines)
    return (F.lit(0.25) + F.lit(0.75) * F.least(F.lit(1.0), size / F.lit(100.0))) * (F.lit(1.0) - F.lit(0.5) * F.least(F.lit(1.0), F.lit(10.0) * symbols)) * (F.lit(1.0) - F.lit(0.5) * repeated)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = SOURCE_WEIGHTS) -> DataFrame:
    """(source, source_size) -> adds target. The level rises until no source is above ``most`` times its size.

    Each round is one aggregate over the sources of which the driver sees two numbers.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "targets")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        held, open_weight = table.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        new = (total - held) / open_weight
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.round(F.least(F.col("cap"), F.col("weight") * level), 6).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies for every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("text")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    tkey = F.xxhash64("doc_id", "text").alias("tkey")
    weighed = (quality_weight(size, F.col("text")) if weight is None else weight).alias("weight")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), u.alias("u"), tkey, weighed)
    keyed = sized.select("*", (-F.log("u") / F.col("weight")).alias("key"))
    base = stored(keyed.select("doc_id", "source", "tkey", "size", "key", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int").alias("bucket")), "mix")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    name = lambda: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")
    ahead = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = base.groupBy(name(), "bucket").agg(F.sum("size").alias("n")).select("name", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = buckets.join(targets.select(name(), "source_size", "target", epochs.alias("epochs")).hint("merge"), "name")
    within = Window.partitionBy("name", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("name", name()).join(plan.hint("merge"), ["name", "bucket"]).withColumn("until", F.col("ahead") + F.sum("size").over(within))
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("until") - F.col("size") / 2 <= budget) & (F.col("size") > 0)
    copies = (F.col("epochs") + F.when(chosen, 1).otherwise(0)).cast("int")
    return placed.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "tkey")


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Every document as many times as the mix takes it, with its columns.

    Rows of equal id, text and source share the copies of all of them: each has as many, the first ones one more.
    """
    plan = mix(docs, seed).where("copies > 0 and size > 0").groupBy(F.col("tkey").alias("k"), F.col("doc_id").alias("d"), F.col("source").alias("s")).agg(F.sum("copies").alias("n"))
    own = docs.select(boxed(docs), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("src"))
    same = (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")) & F.col("src").eqNullSafe(F.col("s"))
    times = lambda rows, n: rows.select("doc", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("i")).select("doc.*")
    if own.groupBy("key", "id", "src").count().where("count > 1").isEmpty():
        return times(own.join(plan.hint("merge"), same), F.col("n"))
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    alike = Window.partitionBy("key", "id", "src")  # of numbers alone; the texts are not moved for it
    light = own.select("row", "key", "id", "src").withColumn("r", F.row_number().over(alike.orderBy("row"))).withColumn("c", F.count("*").over(alike))
    copies = light.join(plan.hint("merge"), same).select("row", (F.floor(F.col("n") / F.col("c")) + F.when(F.col("r") <= F.col("n") % F.col("c"), 1).otherwise(0)).alias("m"))
    return times(own.join(copies.where("m > 0").hint("merge"), "row"), F.col("m"))


ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::double as symbols, string_split(coalesce(text, ''), chr(10)) as ls,
    (('0x' || substr(md5(concat_ws('|', 'mix', doc_id::varchar, text)), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u
  from documents),
k as (select * exclude (ls, symbols), -ln(u) / ((0.25::double + 0.75::double * least(1.0::double, size / 100.0::double))
    * (1.0::double - 0.5::double * least(1.0::double, 10.0::double * (symbols / greatest(size, 1))))
    * (1.0::double - 0.5::double * ((len(ls) - len(list_distinct(ls)))::double / len(ls)))) as key from d),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rk from k group by source),
w as (select *, case rk % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, 2.0::double * source_size as cap from s),
o as (select *, sum(cap) over (order by cap / weight, rk) as held, sum(weight) over () - sum(weight) over (order by cap / weight, rk) as rest,
        1.5 * sum(source_size) over () as total, sum(weight) over () as w_all from w),
l as (select greatest(max(total / w_all), max(case when rest > 0 then (total - held) / rest end)) as level from o),
t as (select source, source_size, round(least(cap, weight * level), 6) as target from w, l),
p as (select k.doc_id, k.size, t.source_size, t.target,
        case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
        sum(k.size) over (partition by k.source order by key, doc_id rows unbounded preceding) as until
      from k join t on k.source is not distinct from t.source),
c as (select *, (epochs + case when size > 0 and until - size / 2.0 <= target - epochs * source_size then 1 else 0 end)::int as copies from p)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies from c
"""
