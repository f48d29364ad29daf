"""Queries on the graph, reports and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.shared import scratch_dir, stored
from foliant.operators import graph, reports, vectors
from foliant.plans.corpora import corpus
from foliant.plans.registry import query
from foliant.plans.search_queries import L2
from foliant.sources import files as rooms

EDGES = "g as (select distinct src, dst, relationship from graph_rows), nodes as (select id, split_part(id, ':', 2) as name, split_part(id, ':', 1) as type from (select src as id from g union select dst from g))"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "graph_rows").groupBy("src", "dst", "relationship").agg(F.min("source_document").alias("source_document"), F.min("context").alias("context"))


# the graph has two sides: suppliers meet in shared parts, and the smallest node of a component is a part
COMP = """pairs as (select distinct src, dst from g), low as (select dst, min(src) as low from pairs group by dst),
meet as (select distinct a.dst as a, b.dst as b from pairs a join pairs b using (src)),
walk as (select dst as id, dst as r from low union select walk.id, meet.b from walk join meet on walk.r = meet.a),
supp as (select id, min(low) as component from walk join low on r = dst group by id),
comp as (select id, component from supp union all select src, min(component) from pairs join supp on dst = id group by src)"""


@query(f"with recursive {EDGES}, {COMP} select id, component from comp")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(edges(spark, sf))


@query(f"""with recursive {EDGES}, {COMP}, n as (select count(*) as n from nodes), m as (select count(*) as m from g), c as (select count(distinct component) as c from comp)
select n as num_nodes, m as num_edges, round(m / (n * (n - 1)), 10) as density, c as num_components, c = 1 as is_connected from n, m, c""")
def graph_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.graph_metrics(graph.nodes_of(e), e)


@query(f"""with {EDGES}, d as (select id, count(*) as degree, count(distinct o) as num_connections from (select src as id, dst as o from g union all select dst, null from g) group by id)
select id, degree, num_connections, round(degree / ((select count(*) from nodes) - 1), 8) as centrality from d order by centrality desc, id limit 10""")
def degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.degree_centrality(graph.nodes_of(e), e)


@query(f"with {EDGES} select 'entity' as kind, type as label, count(*) as n from nodes group by type union all select 'relationship', relationship, count(*) from g group by relationship")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.graph_summary(graph.nodes_of(e), e)


@query(f"""with {EDGES}, q as (select distinct p_partkey::varchar as query from part where p_partkey % 50 = 0),
s as (select query, id, case when name = query then 1.0 else 0.8 end as score from nodes join q on contains(name, query))
select query, id, score, rank from (select *, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10""")
def search_entities(spark: SparkSession, sf: str) -> DataFrame:
    q = corpus(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("query")).distinct()
    return graph.search_entities(graph.nodes_of(edges(spark, sf)), q)


@query(f"""with {EDGES}, q as (select distinct p_partkey::varchar as query from part where p_partkey % 50 = 0),
s as (select query, id, case when name = query then 1.0 else 0.8 end as score from nodes join q on contains(name, query) where type = 'supp')
select query, id, score, rank from (select *, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10""")
def search_entities_of_type(spark: SparkSession, sf: str) -> DataFrame:
    q = corpus(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("query")).distinct()
    return graph.search_entities(graph.nodes_of(edges(spark, sf)), q, types=["supp"])


@query("""with g as (select src, dst, relationship, substr(min(context), 1, 200) as context from graph_rows group by all)
select src as id, dst as other, relationship, 'outgoing' as direction, context from g union all select dst, src, relationship, 'incoming', context from g""")
def entity_relationships(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.entity_relationships(e, graph.nodes_of(e))


@query(f"with {EDGES} select id, relationship, count(*) as n from (select src as id, relationship from g union all select dst, relationship from g) group by all")
def relation_distribution(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.relation_distribution(e, graph.nodes_of(e))


@query("""with home as (select n_nationkey, 'nation:' || n_nationkey || ' > region:' || n_regionkey as tail, 'region:' || n_regionkey as goal from nation),
pairs as (select distinct 'part:' || l_partkey as start, goal from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join home on c_nationkey = n_nationkey),
p as (select distinct 'part:' || l_partkey as start, goal, 'part:' || l_partkey || ' > supp:' || l_suppkey || ' > ' || tail as path from lineitem join supplier on l_suppkey = s_suppkey join home on s_nationkey = n_nationkey),
r as (select *, row_number() over (partition by start, goal order by path) as r from p join pairs using (start, goal)) select start, goal, 3 as length, path from r where r <= 5""")
def find_paths(spark: SparkSession, sf: str) -> DataFrame:
    """How parts come from the regions that they are ordered in: part, supplier, nation, region."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    lines, nation = corpus(spark, sf, "lineitem"), corpus(spark, sf, "nation")
    supplied = corpus(spark, sf, "supplier").select(node("supp", "s_suppkey").alias("src"), node("nation", "s_nationkey").alias("dst"))
    e = lines.select(node("part", "l_partkey").alias("src"), node("supp", "l_suppkey").alias("dst")).distinct()
    e = e.unionAll(supplied).unionAll(nation.select(node("nation", "n_nationkey"), node("region", "n_regionkey")))
    asked = lines.join(corpus(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(corpus(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = asked.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(node("part", "l_partkey").alias("start"), node("region", "n_regionkey").alias("goal"))
    return graph.find_paths(e, asked.distinct())


HOME = """parts as (select distinct l_partkey, l_suppkey from lineitem),
e as (select 'part:' || l_partkey as src, 'supp:' || l_suppkey as dst from parts union all select 'supp:' || s_suppkey, 'nation:' || s_nationkey from supplier union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation),
named as (select distinct 'part:' || l_partkey as id, 'part ' || l_partkey as name from lineitem union all select 'supp:' || s_suppkey, lower(s_name) from supplier union all select 'nation:' || n_nationkey, lower(n_name) from nation union all select 'region:' || r_regionkey, lower(r_name) from region),
q as (select 'part ' || (r_regionkey + 7) as start_name, lower(r_name) as goal_name from region union all select 'supplier#00000000' || (n_nationkey % 10), lower(n_name) from nation)"""


@query(f"""with recursive {HOME},
asked as (select start_name, goal_name, a.id as s, b.id as g from q join named a on contains(a.name, start_name) join named b on contains(b.name, goal_name) where a.id <> b.id),
walk(s, tip, nodes) as (select distinct s, s, [s] from asked union all select s, dst, list_append(nodes, dst) from walk join e on src = tip where len(nodes) <= 3 and not list_contains(nodes, dst)),
p as (select s, g, len(nodes) - 1 as length, array_to_string(nodes, ' > ') as path from walk join (select distinct s, g from asked) using (s) where tip = g),
b as (select * from (select *, row_number() over (partition by s, g order by length, path) as r from p) where r <= 5)
select start_name, goal_name, rank, length::int as length, path from (select start_name, goal_name, length, path, row_number() over (partition by start_name, goal_name order by length, path) as rank from asked join b using (s, g)) where rank <= 10""")
def named_paths(spark: SparkSession, sf: str) -> DataFrame:
    """From parts and suppliers to regions and nations, all by what their names contain."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    lines, supplier, nation, region = (corpus(spark, sf, t) for t in ("lineitem", "supplier", "nation", "region"))
    parts = lines.select("l_partkey").distinct()
    nodes = parts.select(node("part", "l_partkey").alias("id"), F.concat(F.lit("Part "), "l_partkey").alias("name"))
    nodes = nodes.unionAll(supplier.select(node("supp", "s_suppkey"), "s_name")).unionAll(nation.select(node("nation", "n_nationkey"), "n_name")).unionAll(region.select(node("region", "r_regionkey"), "r_name"))
    e = lines.select(node("part", "l_partkey").alias("src"), node("supp", "l_suppkey").alias("dst")).distinct()
    e = e.unionAll(supplier.select(node("supp", "s_suppkey"), node("nation", "s_nationkey"))).unionAll(nation.select(node("nation", "n_nationkey"), node("region", "n_regionkey")))
    names = region.select(F.concat(F.lit("part "), F.col("r_regionkey") + 7).alias("start_name"), F.lower("r_name").alias("goal_name"))
    names = names.unionAll(nation.select(F.concat(F.lit("supplier#00000000"), F.col("n_nationkey") % 10), F.lower("n_name")))
    return graph.named_paths(nodes, e, names)


@query(f"with recursive {EDGES}, {COMP} select component, count(*) as size from comp group by component having count(*) > 1 order by size desc, component limit 5")
def entity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entity_clusters(edges(spark, sf))


@query("""with e as (select 'companies' as entity_type, regexp_extract(text, 'between (.*?), a Delaware', 1) as name, source, doc_no from legal)
select 'companies:' || name as id, arg_max(source, doc_no) as source from e group by name""")
def build_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf, "legal").select(F.lit("companies").alias("entity_type"), F.regexp_extract("text", "between (.*?), a Delaware", 1).alias("name"), "source", F.col("doc_no").alias("ord"))
    return graph.build_nodes(rows).select("id", "source")


@query("""with n as (select c_custkey, 'customer:' || c_name as a from customer), o as (select o_custkey, o_orderkey, 'order:' || o_orderkey as b from orders)
select a as src, b as dst, 'placed' as relationship, 'order_' || o_orderkey as source_document from o join n on o_custkey = c_custkey""")
def build_edges(spark: SparkSession, sf: str) -> DataFrame:
    c, o = corpus(spark, sf, "customer"), corpus(spark, sf, "orders")
    nodes = c.select(F.lit("customer").alias("entity_type"), F.col("c_name").alias("name"), F.lit(0).alias("ord")).union(o.select(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(0)))
    rel = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("source_entity"), F.col("o_orderkey").cast("string").alias("target_entity"), F.lit("placed").alias("relationship_type"), F.concat(F.lit("order_"), "o_orderkey").alias("source_document"), F.lit(1.0).alias("confidence"))
    return graph.build_edges(graph.build_nodes(nodes), rel).drop("confidence")


NEAR = f"""near as (select query_id, vec_id, sim from (select q.vec_id as query_id, e.vec_id, 1 - {L2.format(a="q.embedding", b="e.embedding")} / 2 as sim,
  row_number() over (partition by q.vec_id order by {L2.format(a="q.embedding", b="e.embedding")}, e.vec_id) as r from embeddings q, embeddings e where q.vec_id % 50 = 0) where r <= 20),
ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, id, max(sim) as score from near join nodes on type = 'part' and name::bigint // 10 = vec_id group by all))"""


def _near_entities(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """Chunks (vectors) near a query give the graph's parts that they are the source of."""
    e = corpus(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    near = vectors.knn_l2(e, q, k).select("query_id", F.col("vec_id").cast("string").alias("source"), (1 - F.col("dist") / 2).alias("score"))
    nodes = graph.nodes_of(edges(spark, sf)).where("type = 'part'").select("id", "name", "type", (F.col("name").cast("long") / 10).cast("long").cast("string").alias("source"))
    return graph.semantic_entities(near, nodes, "query_id")


@query(f"with {EDGES}, {NEAR} select query_id, id, score, rank from ranked where rank <= 10")
def semantic_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _near_entities(spark, sf)


@query(f"""with {EDGES}, {NEAR.replace("where r <= 20)", "where r <= 500)")}, top as (select * from ranked where rank <= 10), pairs as (select distinct src, dst from g),
asked as (select a.query_id, a.id as start, b.id as goal, a.score as sa, b.score as sb from top a join top b on a.query_id = b.query_id and a.rank < b.rank and a.rank <= 5),
p as (select start, goal, start || ' > ' || a.dst || ' > ' || goal as path from (select distinct start, goal from asked) join pairs a on a.src = start join pairs b on b.src = goal and b.dst = a.dst),
best as (select *, row_number() over (partition by start, goal order by path) as r from p)
select query_id, start, goal, 2 as length, path, round((sa + sb) / 2, 6) as score from asked join best using (start, goal) where r <= 2""")
def semantic_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Parts near a query that share suppliers: of this graph's two sides, parts are two edges apart."""
    e = edges(spark, sf)
    return graph.semantic_paths(_near_entities(spark, sf, 500), e.select("src", "dst").unionAll(e.select("dst", "src")), "query_id")


CENTRAL = "central as (select id from (select src as id from g union all select dst from g) group by id order by count(*) desc, id limit 1)"


@query(f"""with recursive {EDGES}, {COMP}, {CENTRAL}
select count(*) as num_nodes, (select count(*) from g) as num_edges, count(*) filter (type = 'part') as parts, count(*) filter (type = 'supp') as suppliers, (select id from central) as most_central,
  (select count(distinct component) = 1 from comp)::varchar as is_connected from nodes""")
def graph_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON row, read field by field."""
    e = stored(edges(spark, sf).select("src", "dst"), "edges")
    row = graph.graph_metadata(graph.nodes_of(e), e)
    field = lambda path: F.get_json_object("metadata", path)
    return row.select("num_nodes", "num_edges", field("$.entities.part").cast("long").alias("parts"), field("$.entities.supp").cast("long").alias("suppliers"), field("$.top_central[0]").alias("most_central"), field("$.is_connected").alias("is_connected"))


@query(f"with {EDGES} select 'node' as kind, id as a, name as b, type as c from nodes union all select 'edge', src, dst, relationship from g")
def export_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON rows for a viewer, read field by field."""
    e = edges(spark, sf)
    field = lambda *names: F.coalesce(*[F.get_json_object("row", f"$.{n}") for n in names])
    return graph.export_graph(graph.nodes_of(e), e).select("kind", field("id", "src").alias("a"), field("name", "dst").alias("b"), field("type", "relationship").alias("c"))


@query("select distinct room as store from files")
def list_graphs(spark: SparkSession, sf: str) -> DataFrame:
    return rooms.list_graphs(corpus(spark, sf, "files").withColumnRenamed("room", "store"))


# reports


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf, "legal")
    return rows.select(F.col("store").alias("report"), F.concat(F.lit("doc-"), F.col("doc_no") % 25).alias("doc"), F.col("doc_no").alias("ord"), F.concat(F.lit("excerpt "), F.col("doc_no") % 60).alias("excerpt"), ((F.col("doc_no") % 17) / 17).alias("relevance"))


@query("""with m as (select store as report, 'doc-' || doc_no % 25 as doc, doc_no as ord, 'excerpt ' || doc_no % 60 as excerpt, (doc_no % 17) / 17.0 as relevance from legal),
b as (select report, doc, excerpt, min(ord) as ord, max(relevance) as relevance from m group by all),
d as (select report, doc, min(ord) as f, round(max(relevance), 6) as relevance, list(excerpt order by relevance desc, ord)[1:2] as e from b group by all)
select report, row_number() over (partition by report order by f, doc) as number, doc, relevance, array_to_string(e, ' … ') as excerpts from d""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return reports.citations(_mentions(spark, sf))


@query()
def citation_id(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "files").select("path", reports.citation_id(F.col("path")).alias("citation_id"))


@query("""select source as report, 'See according to **Harbor Deal** and according to **Granite** on ' || source || '.' as text from legal""")
def inline_citations(spark: SparkSession, sf: str) -> DataFrame:
    r = corpus(spark, sf, "legal").select(F.col("source").alias("report"), F.concat(F.lit("See {harbor_deal.pdf} and {granite.txt} on "), "source", F.lit(".")).alias("text"))
    names = r.select("report", F.explode(F.array(F.lit("harbor_deal.pdf"), F.lit("granite.txt"))).alias("name"))
    return reports.inline_citations(r, names)


@query("""with p as (select conv_id as report, turn, text from conversations), t as (select report, string_agg(text, chr(10) || chr(10) order by turn) as text from p group by report),
x as (select report, string_split(text, chr(10) || chr(10)) as ps from t), u as (select report, unnest(range(0, len(ps))) as paragraph, ps from x), n as (select unnest(['the', 'tion', 'qu']) as name)
select report, paragraph::int as paragraph, name from u, n where contains(lower(ps[paragraph + 1]), name)""")
def paragraph_mentions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    r = corpus(spark, sf, "conversations").groupBy(F.col("conv_id").alias("report")).agg(text.alias("text"))
    return reports.paragraph_mentions(r, r.select("report", F.explode(F.array(*map(F.lit, ("the", "tion", "qu")))).alias("name")))


@query("""with c as (select 'tool-' || doc_no % 4 as tool, doc_no % 25 as doc from legal) select coalesce(tool, 'total') as tool, count(*) as n_citations, count(distinct doc) as n_docs from c group by rollup (tool)""")
def citation_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf, "legal").select(F.concat(F.lit("tool-"), F.col("doc_no") % 4).alias("t"), (F.col("doc_no") % 25).alias("doc"))
    return reports.citation_counts(c, "t")


@query("""with w as (select case when size % 3 = 0 then 'missing/' || name else project || '/' || room || '/' || name end as wanted, path from files) select wanted, path from w""")
def resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    f = corpus(spark, sf, "files")
    wanted = f.select(F.when(F.col("size") % 3 == 0, F.concat(F.lit("missing/"), "name")).otherwise(F.concat_ws("/", "project", "room", "name")).alias("wanted"))
    return reports.resolve_paths(wanted, f, ["/data/", "/rooms/"])


@query("""with t as (select p_size, p_name, p_type, p_partkey from part), s as (select p_size, string_agg('## ' || p_name || chr(10) || chr(10) || p_type, chr(10) || chr(10) order by p_partkey) as b from t group by p_size)
select 'Company ' || p_size as company, 'company-' || p_size || '-report.md' as file, '# Company ' || p_size || chr(10) || chr(10) || b as markdown from s""")
def export_reports(spark: SparkSession, sf: str) -> DataFrame:
    p = corpus(spark, sf, "part")
    return reports.export_reports(p.select(F.concat(F.lit("Company "), "p_size").alias("company"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.col("p_type").alias("body")))


@query("""with t as (select p_size, p_name, p_type, p_partkey from part), s as (select p_size, string_agg('## ' || p_name || chr(10) || chr(10) || p_type, chr(10) || chr(10) order by p_partkey) as b from t group by p_size)
select 'company-' || p_size || '-report.md' as file, '# Company ' || p_size || chr(10) || chr(10) || b as text from s""")
def written_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The reports as one committed file per company, read back."""
    p, path = corpus(spark, sf, "part"), scratch_dir(spark, "reports")
    found = reports.export_reports(p.select(F.concat(F.lit("Company "), "p_size").alias("company"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.col("p_type").alias("body")))
    rooms.write_texts(found.select("file", F.col("markdown").alias("text")), path)
    return rooms.read_texts(spark, path)


@query("""with c as (select word, ord, text, focus from (values ('strategic', 1, 'Strategy section'), ('checklist', 2, 'Checklist section'), ('project', 3, 'Project section')) s(word, ord, text),
  (select distinct case event_id % 4 when 0 then 'Strategic project ' when 1 then 'checklist ' when 2 then 'Project and strategic ' else 'other ' end || user_id as focus from events) where contains(lower(focus), word))
select focus, string_agg(text, chr(10) order by ord) as context from c group by focus""")
def context_focus(spark: SparkSession, sf: str) -> DataFrame:
    sections = spark.createDataFrame([("strategic", 1, "Strategy section"), ("checklist", 2, "Checklist section"), ("project", 3, "Project section")], "word string, ord int, text string")
    kind = F.element_at(F.array(*map(F.lit, ("Strategic project ", "checklist ", "Project and strategic ", "other "))), (F.col("event_id") % 4 + 1).cast("int"))
    return reports.context_focus(sections, corpus(spark, sf, "events").select(F.concat(kind, "user_id").alias("focus")).distinct())


@query("select 'document' as type, doc_id::varchar as name, text from documents union all select 'message', conv_id::varchar, text from conversations")
def analysis_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return reports.analysis_corpus(document=corpus(spark, sf, "documents").select(F.col("doc_id").alias("name"), "text"), message=corpus(spark, sf, "conversations").select(F.col("conv_id").alias("name"), "text"))


@query("select item_id as question_id, 'Q: ' || text || chr(10) || 'A: ' || case when length(reverse(text)) > 200 then substr(reverse(text), 1, 200) || '...' else reverse(text) end as insight from benchmark where item_id % 2 = 0")
def qa_insights(spark: SparkSession, sf: str) -> DataFrame:
    b = corpus(spark, sf, "benchmark")
    return reports.qa_insights(b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.reverse("text").alias("sources"), (F.col("item_id") % 2 == 0).alias("has_answer")))


@query("""with t as (select count(*) as t from run_log) select coalesce(status, 'total') as status, count(*) as n, round(100.0 * count(*) / max(t), 4) as percent from run_log, t group by rollup (status)""")
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.build_report(corpus(spark, sf, "run_log"))


@query("select stage, arg_max(status, (ts, event_id)) as status, max(ts) as last_run, count(*) as n_runs from run_log group by stage")
def stage_status(spark: SparkSession, sf: str) -> DataFrame:
    return reports.stage_status(corpus(spark, sf, "run_log"))


@query("select stage, count(*) as n from run_log where ts > (select max(ts) - interval 7 days from run_log) group by stage")
def expire_results(spark: SparkSession, sf: str) -> DataFrame:
    log = corpus(spark, sf, "run_log")
    latest = log.agg(F.max("ts").alias("latest"))  # one row
    kept = reports.expire_results(log.crossJoin(F.broadcast(latest)), F.col("latest"), 7)
    return kept.groupBy("stage").agg(F.count("*").alias("n"))


@query("select count(distinct letter) as n_categories, count(*) as n_questions from checklist")
def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "checklist").agg(F.count_distinct("letter").alias("n_categories"), F.count("*").alias("n_questions"))


@query(f"""with {EDGES}, {NEAR}, r as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from ranked where id <> 'part:' || (query_id * 10))
select query_id, id, score, rank from r where rank <= 100""")
def related_by_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's context is the vector that it stems from."""
    e = corpus(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    near = vectors.knn_l2(e, q, 20).select("query_id", F.col("vec_id").cast("string").alias("source"), (1 - F.col("dist") / 2).alias("score"))
    nodes = graph.nodes_of(edges(spark, sf)).where("type = 'part'").select("id", (F.col("name").cast("long") / 10).cast("long").cast("string").alias("source"))
    return graph.related_by_context(near, nodes, q.select("query_id", F.concat(F.lit("part:"), F.col("query_id") * 10).alias("id")), "query_id", limit=100)


@query(f"with {EDGES} select 'nodes' as part, id as a, name as b from nodes union all select 'edges', src, dst from g union all select 'metadata', (select count(*) from nodes)::varchar, (select count(*) from g)::varchar")
def save_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Writes nodes, edges and metadata and gives what reading them gives."""
    e, path = stored(edges(spark, sf), "edges"), scratch_dir(spark, "graph")
    nodes = graph.nodes_of(e)
    rooms.save_graph(nodes, e, graph.graph_metadata(nodes, e), path)
    fields = {"nodes": ("id", "name"), "edges": ("src", "dst"), "metadata": ("num_nodes", "num_edges")}
    parts = [spark.read.parquet(f"{path}/{p}").select(F.lit(p).alias("part"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for p, (a, b) in fields.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("""select name, kind, replace(replace(template, '{name}', name), '{text}', case when length(text) > 1000 then substr(text, 1, 1000) || '...' else text end) as prompt
from files, (values ('overview', 'Describe {name}: {text}'), ('risks', 'List the risks in {text}')) t(kind, template)""")
def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    templates = spark.createDataFrame([("overview", "Describe {name}: {text}"), ("risks", "List the risks in {text}")], "kind string, template string")
    return reports.prompt_table(corpus(spark, sf, "files"), templates, "name", "text")
