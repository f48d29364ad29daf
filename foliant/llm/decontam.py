"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

1. Document frequencies of all benchmark words are counted over all documents.
2. Every window of an item (``WINDOW`` consecutive words, or the whole of a shorter item) is anchored at its rarest word.
3. The index keeps a posting (word, document, position) for every place of an anchor word, with the words around it, and
   one posting of the empty word at the end of each document, which gives the document's length.
4. Anchors meet their postings; offset-adjusted neighbours are intersected outwards from the rarest word, which gives
   the matched run around it. Runs as long as a window are exact phrase matches. Windows all of whose words stand within
   ``REACH`` places of a posting of their rarest word, in any order, are proximity matches.

Benchmark words and anchors are broadcast in blocks of about ``BLOCK_BYTES`` bytes in memory, so a benchmark of any size is
met in blocks.
A document is hit by the union of its runs, so results do not depend on how often a passage occurs elsewhere.

Defined cases: a null or empty text has no words; items without words are never found; repeated rows get equal results;
an empty benchmark hits nothing; equal item ids count once; other columns are ignored or, in ``clean_documents``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.shared import stored

# Fixed values of the contract: what a word is before A-Z are lowered, and the length of a window. The class names what it
# holds, the most frequent range first: Java tests the ranges in turn, and the negated form takes seven times as long.
WORD_ANY_CASE = r"[a-zA-Z0-9\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
REACH = WINDOW - 1 + 8  # places on each side of a rarest word
BLOCK_BYTES = 64 << 20


def words_of(text: str | Column) -> Column:
    """The words of a text, A-Z not yet lowered."""
    return F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _held_bytes(table: DataFrame) -> Column:
    """At least what a row of words, and of (nested) arrays of words, takes in memory."""
    held = F.lit(64).cast("long")
    for field in table.schema:
        kind, column = field.dataType.simpleString(), F.col(field.name)
        if kind == "array<array<string>>":
            held, column, kind = held + 32 * F.size(column), F.flatten(column), "array<string>"
        if kind == "array<string>":
            held += F.aggregate(column, F.lit(32).cast("long"), lambda n, w: n + 16 + F.octet_length(w))
        else:
            held += 16 + F.coalesce(F.octet_length(column.cast("string")), F.lit(0))
    return held


def _blocks(table: DataFrame) -> list[DataFrame]:
    """A stored table in parts that may be broadcast: about ``BLOCK_BYTES`` each, dealt by the hash of the whole row."""
    n = max(1, -(-(table.agg(F.sum(_held_bytes(table))).first()[0] or 0) // BLOCK_BYTES))
    return [table if n == 1 else table.where(F.pmod(F.xxhash64(*table.columns), F.lit(n)) == i) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_anchors(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, item_id, len, before, after, windows): one row per item and anchored offset, stored.

    ``windows`` has the distinct words of each window that the word is the rarest of.
    """
    items = benchmark.select("item_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("t")).select("item_id", words_of("t").alias("words"))
    items = stored(items.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    placed = items.select("item", F.posexplode("words").alias("at", "word"))
    vocabulary = stored(placed.select("word").distinct(), "vocabulary")
    spread = docs.select(F.explode(words_of("text")).alias("raw")).select(lowered(F.col("raw")).alias("word"))
    counts = _union([spread.join(F.broadcast(v), "word").groupBy("word").agg(F.count("*").alias("df")) for v in _blocks(vocabulary)])
    rare = placed.join(stored(counts, "df").hint("merge"), "word", "left").select("item", "at", "word", F.coalesce("df", F.lit(0)).alias("df"))
    listed = rare.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "df"))).alias("dfs")).join(items.hint("merge"), "item")
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    rarest = lambda s: F.array_min(F.transform(F.slice("dfs", s, length), lambda x: F.struct(x["df"], x["at"])))["at"]
    spans = listed.select("item_id", "words", length.alias("len"), F.transform(starts, lambda s: F.struct(s.alias("s"), rarest(s).alias("at"))).alias("spans"))
    anchors = spans.select("*", F.explode(F.array_distinct(F.transform("spans", lambda x: x["at"]))).alias("at"))
    first = F.greatest(F.col("at") - F.col("len") + 1, F.lit(0))
    own = F.filter("spans", lambda x: x["at"] == F.col("at"))
    return stored(
        anchors.select(
            F.get("words", F.col("at")).alias("word"),
            "item_id",
            "len",
            F.reverse(F.slice("words", first + 1, F.col("at") - first)).alias("before"),
            F.slice("words", F.col("at") + 2, F.col("len") - 1).alias("after"),
            F.array_distinct(F.transform(own, lambda x: F.array_sort(F.array_distinct(F.slice("words", x["s"], F.col("len")))))).alias("windows"),
        ),
        "anchors",
    )


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The index: (word, doc_id, key, at, before, after) for every place of the terms, stored as it is read.

    Each document's words are followed by an empty one, which is a term of every index.
    """
    ended = F.concat(F.col("words"), F.array(F.lit("")))
    spread = docs.select("doc_id", document_key().alias("key"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    spread = spread.select("doc_id", "key", "words", F.posexplode(ended).alias("at", "raw")).select("doc_id", "key", "words", "at", lowered(F.col("raw")).alias("word"))
    first = F.greatest(F.col("at") - reach, F.lit(0))
    around = lambda a: F.when(F.col("word") != "", F.transform(a, lowered))
    terms = stored(terms.select("word").unionAll(terms.sparkSession.range(1).select(F.lit(""))).distinct(), "terms")
    parts = [
        spread.join(F.broadcast(t), "word").select(
            *["word", "doc_id", "key", "at"],
            around(F.reverse(F.slice("words", first + 1, F.col("at") - first))).alias("before"),
            around(F.slice("words", F.col("at") + 2, F.lit(reach))).alias("after"),
        )
        for t in _blocks(terms)
    ]
    return stored(_union(parts), "postings")


def phrase_hits(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, start, end, exact): matched runs of document words, and proximity matches (exact false)."""
    index = index.where("word != ''").select("word", "doc_id", "key", "at", F.col("before").alias("b"), F.col("after").alias("a"))
    run = lambda doc, item: F.coalesce(  # noqa: E731  equal words from the anchor outwards
        F.nullif(F.array_position(F.zip_with(F.slice(doc, F.lit(1), F.size(item)), item, lambda x, y: F.coalesce(x == y, F.lit(False))), False), F.lit(0)) - 1, F.size(item)
    )
    parts = []
    for block in _blocks(anchors):
        met = index.join(F.broadcast(block), "word").select("*", run(F.col("b"), F.col("before")).cast("int").alias("left"), run(F.col("a"), F.col("after")).cast("int").alias("right"))
        exact = F.col("left") + F.col("right") + 1 >= F.col("len")
        around = F.concat("a", "b", F.array("word"))
        beside = F.exists("windows", lambda w: F.size(F.array_except(w, around)) == 0)
        parts.append(met.where(exact | beside).select("doc_id", "key", "item_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"), exact.alias("exact")))
    return _union(parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items near by, exact ones included)."""
    anchors = item_anchors(docs, benchmark, window)
    index = postings(docs, anchors.select("word").distinct(), max(REACH, window - 1))
    hits = phrase_hits(index, anchors)
    item = F.col("item_id").cast("string")
    found = hits.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.struct("start", "end")))).alias("runs"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), item))).alias("items"),
        F.count_distinct("item_id").alias("n_near"),
    )
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
    grow = lambda s, r: F.struct(F.greatest(s["end"], r["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(s["end"], r["start"] - 1))).alias("n"))
    found = found.select("doc_id", "key", F.aggregate("runs", zero, grow, lambda s: s["n"]).cast("long").alias("n_hit"), "items", "n_near")
    sizes = index.where("word = ''").select("doc_id", "key", F.col("at").cast("long").alias("n_words"))
    f = found.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_hit", "items", "n_near")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return sizes.join(f.hint("merge"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        *["doc_id", "key", "n_words"],
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    bad = decontaminate(docs, benchmark, window).where("contaminated").select("doc_id", "key").distinct().alias("bad")
    return docs.alias("all").join(bad.hint("merge"), F.expr("xxhash64(all.doc_id, all.text) = bad.key and all.doc_id <=> bad.doc_id"), "left_anti")


ORACLE = """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
j as (select item_id, w, least(13, len(w)) as n from i where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as p from j)),
sizes as (select distinct n from j),
dw as (select r, p, n, array_to_string(w[p : p + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
m as (select r, p, dw.n, item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
h as (select r, count(distinct q)::bigint as n_hit from (select r, unnest(range(p, p + n)) as q from m) group by r),
t as (select r, count(distinct item_id)::bigint as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from m group by r),
dp as (select r, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
f as (select word, count(*) as df from dp group by word),
jw as (select row_number() over () as k, item_id, n, w, s from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from j)),
q as (select k, unnest(range(s, s + n)) as o, unnest(w[s : s + n - 1]) as word from jw),
rare as (select k, first(q.word order by coalesce(df, 0), o) as word from q left join f using (word) group by k),
near as (select dp.r, count(distinct item_id)::bigint as n_near
  from rare join jw using (k) join dp on dp.word = rare.word join d on d.r = dp.r
  where list_has_all(d.w[greatest(dp.p - 20, 1) : dp.p + 20], jw.w[jw.s : jw.s + jw.n - 1]) group by dp.r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join h using (r) left join t using (r) left join near using (r)
"""
