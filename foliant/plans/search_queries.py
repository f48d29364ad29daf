"""Queries on dense search, fusion, checklists and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.shared import scratch_dir, sent, stored
from foliant.operators import checklist as ck
from foliant.operators import features, sparse, vectors
from foliant.plans.corpora import corpus
from foliant.plans.registry import query
from foliant.plans.text_queries import BM25
from foliant.sources import files as rooms

DOT = "round(list_cosine_similarity({a}::double[], {b}::double[]), 6)"
L2 = "round(list_sum(list_transform(list_zip({a}::double[], {b}::double[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"
PAIRS = f"""
q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 50 = 0),
pairs as (select query_id, vec_id, {L2.format(a="qv", b="embedding")} as dist from q, embeddings),
near as (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from pairs)
"""


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query(f"with {PAIRS} select query_id, vec_id, dist, rank from near where rank <= 10")
def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.knn_l2(corpus(spark, sf, "embeddings"), _queries(spark, sf), 10)


@query(f"with {PAIRS} select query_id, vec_id, (case when dist <= 2 then 1 - dist / 2 else 0 end) as similarity from near where rank <= 20")
def distance_to_similarity(spark: SparkSession, sf: str) -> DataFrame:
    near = vectors.knn_l2(corpus(spark, sf, "embeddings"), _queries(spark, sf), 20)
    return near.select("query_id", "vec_id", vectors.distance_to_similarity(F.col("dist")).alias("similarity"))


def _label_score(query_id: str = "query_id", vec_id: str = "vec_id") -> str:
    return f"round(cast(({query_id} * 7 + {vec_id} * 13) % 101 as double) / 101, 6)"


@query(f"""with {PAIRS},
l as (select query_id, vec_id, (case when dist <= 2 then 1 - dist / 2 else 0 end) as similarity from near where rank <= 20),
f as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as r, {_label_score()} as score from l where similarity >= 0.2),
g as (select *, row_number() over (partition by query_id order by score desc, similarity desc, vec_id) as rank from f where r <= 15)
select query_id, vec_id, similarity, score, rank from g where rank <= 5""")
def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    rescore = lambda df: df.withColumn("score", F.expr(_label_score()))
    return vectors.semantic_search(corpus(spark, sf, "embeddings"), _queries(spark, sf), rescore)


@query(f"with q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 50 = 0) select query_id, vec_id, {DOT.format(a='qv', b='embedding')} as score from q, embeddings")
def cosine_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.cosine_matrix(corpus(spark, sf, "embeddings"), _queries(spark, sf))


VARIANTS = f"""
asked as (select vec_id // 50 as focus_id, embedding::double[] as x from embeddings where vec_id % 50 = 0),
v as (select focus_id, 0 as variant, x as qv from asked union all select focus_id, 1, list_reverse(x) from asked union all select focus_id, 2, list_transform(x, lambda y: -y) from asked),
p as (select focus_id, variant, vec_id, {L2.format(a="qv", b="embedding")} as dist from v, embeddings),
n as (select *, row_number() over (partition by focus_id, variant order by dist, vec_id) as r from p where dist <= 1.9),
t as (select n.*, 'label ' || label as text from n join embeddings using (vec_id) where r <= 5),
b as (select *, row_number() over (partition by focus_id, text order by dist, vec_id) as k from t),
found as (select focus_id, vec_id, text, dist, row_number() over (partition by focus_id order by dist, vec_id) as rank from b where k = 1)
"""


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """Three vectors per query row: its own, reversed and negated."""
    x = F.col("embedding").cast("array<double>")
    asked = corpus(spark, sf, "embeddings").where("vec_id % 50 = 0")
    return asked.select(F.expr("vec_id div 50").alias("focus_id"), F.posexplode(F.array(x, F.reverse(x), F.transform(x, lambda y: -y))).alias("variant", "query_vec"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus(spark, sf, "embeddings")
    variants = _variants(spark, sf)
    texts = e.select("vec_id", F.concat(F.lit("label "), "label").alias("text"))
    return vectors.multi_query_search(e, variants, texts, 5, 1.9)


@query(f"with {VARIANTS} select focus_id, rank, vec_id, text, dist from found")
def multi_query_search(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)


@query(f"""with {VARIANTS}, c as (select distinct vec_id // 50 as focus_id from embeddings), s as (select focus_id, count(*) as n from found where rank <= 2 and dist <= 1.5 group by focus_id)
select focus_id, coalesce(n, 0) as n_sources, case when coalesce(n, 0) >= 2 then 'SUPPORTED' when n = 1 then 'PARTIALLY SUPPORTED' else 'UNSUPPORTED' end as status from c left join s using (focus_id)""")
def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    claims = corpus(spark, sf, "embeddings").select(F.expr("vec_id div 50").alias("focus_id"))
    return vectors.claim_support(claims, _found(spark, sf).where("rank <= 2 and dist <= 1.5"))


@query(f"""with {BM25},
s as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0) where r <= 20),
dn as (select item_id, vec_id as doc_id, sim from (select item_id, e.vec_id, 1 - {L2.format(a="b.embedding", b="e.embedding")} / 2 as sim, row_number() over (partition by item_id order by {L2.format(a="b.embedding", b="e.embedding")}, e.vec_id) as r
   from benchmark join embeddings b on item_id = b.vec_id, embeddings e) where r <= 20),
u as (select coalesce(s.item_id, dn.item_id) as item_id, coalesce(s.doc_id, dn.doc_id) as doc_id, coalesce(score, 0.0) as sparse_score, coalesce(sim, 0.0) as dense_score from s full join dn on s.item_id = dn.item_id and s.doc_id = dn.doc_id),
h as (select *, round(0.3 * sparse_score + 0.7 * dense_score, 8) as score from u)
select item_id, doc_id, sparse_score, dense_score, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from h) where rank <= 10""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 by the item's words and vectors by the item's id, fused on the document id."""
    e = corpus(spark, sf, "embeddings")
    found = sparse.bm25_search(corpus(spark, sf, "documents"), corpus(spark, sf, "benchmark"), "doc_id", "item_id", top_k=20)
    asked = corpus(spark, sf, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", F.col("embedding").alias("query_vec"))
    near = vectors.knn_l2(e, asked, 20, query_key="item_id").select("item_id", F.col("vec_id").alias("doc_id"), (1 - F.col("dist") / 2).alias("score"))
    return vectors.hybrid_search(found, near, "doc_id", "item_id")


WORDS = "list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), lambda w: w <> ''))"


@query(f"""with {BM25}, hits as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0) where r <= 10)
select item_id, doc_id, round(len(list_intersect({WORDS.format(t="b.text")}, {WORDS.format(t="d.text")})) / greatest(len({WORDS.format(t="b.text")}), 1), 6) as score
from hits join benchmark b using (item_id) join documents d using (doc_id)""")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best hits of every item, rescored."""
    b, d = corpus(spark, sf, "benchmark"), corpus(spark, sf, "documents")
    hits = stored(sparse.bm25_search(d, b, "doc_id", "item_id").select("item_id", "doc_id"), "hits")
    texts = d.select("doc_id", F.col("text").alias("t")).join(sent(hits), "doc_id")  # only texts of hits are moved
    pairs = texts.join(b.select("item_id", F.col("text").alias("q")).hint("merge"), "item_id")
    return vectors.rerank(pairs, "q", "t").select("item_id", "doc_id", "score")


@query()
def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The default vectors of all documents; the tests hold them against the formulas."""
    docs = corpus(spark, sf, "documents").select("doc_id", "text")
    return features.fit_text_vectors(docs)(docs, "text", "embedding").drop("text")


@query()
def embed_with(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by a caller's model."""
    return vectors.embed_texts(corpus(spark, sf, "documents").select("doc_id", "text"), "text", vectors.hashed_embedder()).drop("text")


@query(f"""with e as (select vec_id, embedding::double[] as v from embeddings), q as (select vec_id as query_id, list_transform(v, lambda x, i: x + case when i = 1 then 0.05 else 0 end) as qv from e),
s as (select query_id, vec_id, {DOT.format(a='qv', b='v')} as score from q, e) select query_id, vec_id, score from s where score >= 0.9""")
def lsh_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Moved copies of all vectors find their origins by random projections; the tests measure recall at the limit."""
    e = corpus(spark, sf, "embeddings")
    moved = e.select(F.col("vec_id").alias("query_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == 0, 0.05).otherwise(0.0)).alias("query_vec"))
    return features.lsh_cosine_pairs(e, moved, 0.9, 64)


@query(f"""with {PAIRS}, l as (select query_id, vec_id, 1 - dist as similarity, dist as score from near where rank <= 20 and dist >= 0.2)
select * from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from l) where rank <= 5""")
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The literal score mode; a missing index gives no rows."""
    rescore = lambda df: df.withColumn("score", F.expr(_label_score()))
    q = _queries(spark, sf)
    none = vectors.search_documents(None, q, rescore).select("query_id", "vec_id", "similarity", "score", "rank")
    return vectors.search_documents(corpus(spark, sf, "embeddings"), q, rescore, score_mode="distance").unionByName(none)


@query("select 'type ' || label as type_key, count(*) as n, true as same from embeddings where label <> 3 group by label")
def type_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct normalised document type is embedded once; rows of a type have its vector."""
    label = F.when(F.col("label") == 3, " Not Classified").otherwise(F.concat(F.lit("Type "), "label"))
    types = corpus(spark, sf, "embeddings").select("vec_id", label.alias("type"))
    found = vectors.type_vectors(types, "type", lambda df, text, out: vectors.embed_texts(df, text, vectors.hashed_embedder(), out))
    return found.groupBy("type_key").agg(F.count("*").alias("n"), (F.count_distinct("embedding") == 1).alias("same"))


# checklists

SCORES = f"""
scores as (select item_no, e.vec_id, round({DOT.format(a="i.embedding", b="e.embedding")}, 3) as score from checklist c join embeddings i on i.vec_id = c.vec_id, embeddings e where e.vec_id % 7 <> 0 or e.vec_id > 175),
pool as (select *, row_number() over (partition by item_no order by score desc, vec_id) as rank from scores),
cand as (select * from pool where rank <= case when item_no % 5 = 4 then 3 else 30 end and item_no % 5 <> 3),
st as (select item_no, count(*) as n_candidates, round(avg(score) + 1.5 * greatest(stddev_pop(score), 0.05), 6) as lim from cand group by item_no),
matches as (select item_no, vec_id, score, rank, n_candidates, case when n_candidates < 5 then 0.0 else lim end as threshold, case when n_candidates < 5 then 'insufficient_data' else 'statistical' end as method
  from cand join st using (item_no) where n_candidates < 5 or score >= lim)
"""


def _checklist_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of item vectors with the others; some items get few candidates, some none."""
    e, c = corpus(spark, sf, "embeddings"), corpus(spark, sf, "checklist")
    items = c.join(e, "vec_id").select("item_no", F.col("embedding").alias("query_vec"))
    scores = vectors.cosine_matrix(e.where("vec_id % 7 <> 0 or vec_id > 175"), items, query_key="item_no")
    return scores.withColumn("score", F.round("score", 3))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), "vec_id"))
    return _checklist_scores(spark, sf).withColumn("rank", rank).where("rank <= if(item_no % 5 = 4, 3, 30) and item_no % 5 <> 3")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return ck.significant_matches(_candidates(spark, sf))


@query(f"with {SCORES} select item_no, vec_id, score, rank, n_candidates, threshold, method from matches")
def significant_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf)


@query(f"with {SCORES} select item_no, count(*) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, min(score) as low, max(score) as high from cand group by item_no")
def match_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return ck.match_statistics(_candidates(spark, sf))


@query(f"""with {SCORES.replace("rank <= case when item_no % 5 = 4 then 3 else 30 end and item_no % 5 <> 3", "rank <= 30")} select item_no, vec_id, score, rank, n_candidates, threshold, method from matches""")
def match_checklist(spark: SparkSession, sf: str) -> DataFrame:
    return ck.match_checklist(_checklist_scores(spark, sf))


ROLL = f"""{SCORES}, n as (select item_no, count(*) as n from matches group by item_no),
roll as (select letter, category, count(*) as total_items, count(*) filter (n > 0) as matched_items from checklist left join n using (item_no) group by letter, category)"""


@query(f"with {ROLL} select letter, category, total_items, matched_items from roll")
def category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ck.category_rollup(corpus(spark, sf, "checklist"), _matches(spark, sf))


@query(f"with {ROLL}, p as (select *, round(coalesce(100.0 * matched_items / nullif(total_items, 0), 0), 1) as percent from roll), t as (select *, case when percent > 80 then 'strong compliance' when percent > 50 then 'moderate compliance' else 'gaps' end as tier from p) select letter, percent, tier, category || ': ' || matched_items || ' of ' || total_items || ' items matched, ' || tier as insight from t")
def checklist_insights(spark: SparkSession, sf: str) -> DataFrame:
    return ck.checklist_insights(ck.category_rollup(corpus(spark, sf, "checklist"), _matches(spark, sf)))


@query(f"with {SCORES}, n as (select item_no, count(*) as n from matches where score >= 0.25 group by item_no) select item_no, text, coalesce(n, 0) as n_shown, case when n > 0 then '✅' else '❌' end as mark, coalesce(n, 0) || case when n = 1 then ' document' else ' documents' end as label from checklist left join n using (item_no)")
def display_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ck.display_filter(corpus(spark, sf, "checklist"), _matches(spark, sf))


@query("select letter, category, item_no, text, coalesce(original, text) as original, vec_id from checklist where trim(text) <> ''")
def valid_items(spark: SparkSession, sf: str) -> DataFrame:
    return ck.valid_items(corpus(spark, sf, "checklist"))


@query("select item_no, category || ': ' || text as document from checklist")
def question_document(spark: SparkSession, sf: str) -> DataFrame:
    return ck.question_document(corpus(spark, sf, "checklist").withColumnRenamed("text", "question")).select("item_no", "document")


@query("select distinct lower(trim(source)) as key from documents where lower(trim(source)) not in (select lower(source) from documents where doc_id % 20 < 3)")
def distinct_keys_to_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf, "documents")
    return ck.distinct_keys(docs, "source", docs.where("doc_id % 20 < 3").select(F.lower("source").alias("key")).distinct())


BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PAGES = f"""
ls as (select doc_id, string_split(text, chr(10)) as ls from documents),
md as (select doc_id as file, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (doc_id % 26)::int + 1, 1) as letter, i + 1 as n, i % 3 = 2 as bullet, trim(ls[i + 1], {BLANKS}) as t, ls[i + 1] as l from (select doc_id, ls, unnest(range(0, len(ls))) as i from ls)),
items as (select *, row_number() over (partition by file order by n) as item_no, replace(translate(t, '‘’“”', chr(39) || chr(39) || chr(34) || chr(34)), '\\&', '&') as clean from md where not bullet and t <> '')
"""


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a markdown checklist: a lettered heading, and each line of the text as a numbered item or a bullet."""
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("doc_id") % 26 + 1).cast("int"), F.lit(1))
    item = lambda line, i: F.when(i % 3 == 2, F.concat(F.lit("- "), line)).otherwise(F.concat(F.lit("\t"), i + 1, F.lit(". "), line))
    body = F.array_join(F.transform(F.split("text", "\n", -1), item), "\n")
    return corpus(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit("## "), letter, F.lit(". Section "), "doc_id", F.lit("\n"), body).alias("text"))


@query(f"with {PAGES} select file, n::int as line_no, t as text from items where length(t) > 10 and not (t = upper(t) and t <> lower(t))")
def parse_numbered_items(spark: SparkSession, sf: str) -> DataFrame:
    return ck.parse_numbered_items(_markdown(spark, sf))


@query(f"with {PAGES} select file, n::int as line_no, t as text from md where length(t) > 10 and not (t = upper(t) and t <> lower(t))")
def parse_list_items(spark: SparkSession, sf: str) -> DataFrame:
    return ck.parse_list_items(_markdown(spark, sf))


@query(f"with {PAGES} select file, letter || '.' || item_no as id, 'Section ' || file as category, clean as question from items")
def parse_questions(spark: SparkSession, sf: str) -> DataFrame:
    return ck.parse_questions(_markdown(spark, sf))


HITS = f"""{PAIRS}, hits as (select query_id, rank, 'doc_' || vec_id || '.txt' as name, (case when dist <= 2 then 1 - dist / 2 else 0 end) as score, coalesce(d.text, '') as text from near left join documents d on d.doc_id = vec_id where rank <= 8)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    near = vectors.knn_l2(corpus(spark, sf, "embeddings"), _queries(spark, sf), 8)
    score = vectors.distance_to_similarity(F.col("dist"))
    texts = corpus(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return near.join(texts.hint("merge"), "vec_id", "left").select("query_id", "rank", F.concat(F.lit("doc_"), "vec_id", F.lit(".txt")).alias("name"), score.alias("score"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"""with {HITS}, s as (select query_id, string_agg(name, '; ' order by rank) as sources, count(*) as n_sources from hits where rank <= 5 and score >= 0.3 group by query_id)
select query_id, coalesce(sources, '') as sources, coalesce(n_sources, 0) as n_sources, n_sources is not null as has_answer from q left join s using (query_id)""")
def answer_questions_search(spark: SparkSession, sf: str) -> DataFrame:
    return ck.answer_questions(_queries(spark, sf), _hits(spark, sf), 0.3, "query_id")


@query(f"""with {HITS}, c as (select query_id, string_agg('- ' || name || ': ' || substr(text, 1, 200) || '...', chr(10) order by rank) as context from hits where rank <= 5 and score >= 0.2 group by query_id)
select query_id, context, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer the question ' || query_id || '.' as prompt from c""")
def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    return ck.rag_context(_hits(spark, sf), "query_id", 0.2)


@query("""with r as (select room, name, text, row_number() over (partition by room order by name) as rank from files)
select room, string_agg('## ' || name || chr(10) || case when length(text) > 1000 then substr(text, 1, 1000) || '...' else text end, chr(10) || chr(10) order by rank) as context from r where rank <= 5 group by room""")
def context_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ck.context_documents(corpus(spark, sf, "files"), "room", "name", "text")


@query(f"""with {HITS}, s as (select query_id, count(*) as n from hits where rank <= 5 and score >= 0.3 group by query_id)
select count(*) as questions, count(n) as answered from q left join s using (query_id)""")
def answered_count(spark: SparkSession, sf: str) -> DataFrame:
    a = ck.answer_questions(_queries(spark, sf), _hits(spark, sf), 0.3, "query_id")
    return a.agg(F.count("*").alias("questions"), F.count_if("has_answer").alias("answered"))




@query("select doc_id, source, 'answer_' || (row_number() over (order by source, doc_id) - 1) as key from documents")
def keyed_results(spark: SparkSession, sf: str) -> DataFrame:
    return ck.keyed_results(corpus(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"], "answer")


@query("select category as file, letter, category, row_number() over (partition by category, letter order by item_no)::int as item_no, text, coalesce(original, text) as original from checklist")
def nested_checklists(spark: SparkSession, sf: str) -> DataFrame:
    """Checklists as nested JSON, one committed file per checklist, read back and flattened."""
    path = scratch_dir(spark, "checklists")
    nested = rooms.nested_checklists(corpus(spark, sf, "checklist").withColumn("file", F.col("category")))
    rooms.write_texts(nested.select("file", F.col("json").alias("text")), path)
    return rooms.flat_checklists(rooms.read_texts(spark, path).withColumnRenamed("text", "json"))


TEXTS = "t as (select doc_id as vec_id, text from documents)"


@query(f"""with {PAIRS}, {TEXTS}, n as (select query_id, vec_id, rank, dist, text from near join t using (vec_id) where rank <= 8 and dist <= 1.5),
a as (select *, instr(lower(text), 'the that') as p from n), b as (select *, greatest(p - 101, 0) as f, least(p - 1 + 300, length(text)) as l from a)
select query_id, rank, vec_id, case when p > 0 then case when f > 0 then '...' else '' end || substr(text, f + 1, l - f) || case when l < length(text) then '...' else '' end else substr(text, 1, 400) end as excerpt,
  (case when dist <= 2 then 1 - dist / 2 else 0 end) as relevance from b""")
def document_search(spark: SparkSession, sf: str) -> DataFrame:
    texts = corpus(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.document_search(corpus(spark, sf, "embeddings"), _queries(spark, sf).withColumn("query_text", F.lit("The that")), texts)


FOCUS = VARIANTS.replace("b as (select *, row", "near_rows as (select *, row").replace("from b where k = 1", "from near_rows where k = 1").replace("select n.*, 'label ' || label as text from n join embeddings using (vec_id) where r <= 5", "select n.*, text from n join (select doc_id as vec_id, text from documents) using (vec_id) where r <= 5")


@query(f"""with {FOCUS}, a as (select *, instr(lower(text), 'the') as h, case when instr(lower(text), 'ing') > 0 then instr(lower(text), 'ing') else instr(lower(text), 'tion') end as k from found where rank <= 4),
b as (select *, least(h, k) - 1 as mid from a)
select focus_id, rank, vec_id, case when h > 0 and k > 0 then substr(text, greatest(mid - 100, 0) + 1, mid + 350 - greatest(mid - 100, 0)) end as excerpt from b""")
def focus_search(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus(spark, sf, "embeddings")
    variants = _variants(spark, sf)
    texts = corpus(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.focus_search(e, variants, texts, F.lit("the"), ["ing", "tion"], 5, 1.9)


@query(f"with {PAIRS} select query_id, rank, 'type ' || label as type, 'row ' || near.vec_id as name, dist from near join embeddings e on e.vec_id = near.vec_id where rank <= 5 and dist <= 1.5")
def analysis_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf, "embeddings").select("vec_id", "embedding", F.concat(F.lit("type "), "label").alias("type"), F.concat(F.lit("row "), "vec_id").alias("name"))
    return vectors.analysis_search(rows, _queries(spark, sf))


@query(f"with {PAGES} select file, letter, 'Section ' || file as category, item_no::int as item_no, clean as text, trim(n || '. ' || l, {BLANKS}) as original from items")
def parse_checklist(spark: SparkSession, sf: str) -> DataFrame:
    return ck.parse_checklist(_markdown(spark, sf))
