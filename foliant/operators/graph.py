"""A knowledge graph as node and edge tables: metrics, search, bounded paths, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.components import connected_components
from foliant.functions.shared import stored

GRAM = 3


def build_nodes(entities: DataFrame) -> DataFrame:
    """id ``type:name`` per named entity; of rows with equal id the last one (by ``ord``) stays."""
    rows = entities.where(F.trim("name") != "").withColumn("id", F.concat_ws(":", "entity_type", "name"))
    w = Window.partitionBy("id").orderBy(F.desc("ord"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def build_edges(nodes: DataFrame, relations: DataFrame, match: str = "exact") -> DataFrame:
    """Edges between nodes whose names are (``exact``) or contain (``contains``) the ends of a relation; no loops."""
    n = nodes.select("id", F.lower("name").alias("n"))
    ends = relations.select(F.lower("source_entity").alias("e")).union(relations.select(F.lower("target_entity"))).distinct()
    if match == "exact":
        found = ends.join(n.hint("merge"), F.col("n") == F.col("e")).select("e", "id")
    else:
        found = containing(n.select("n"), ends).join(n.hint("merge"), "n").select("e", "id")
    a, b = found.select(F.col("e").alias("s"), F.col("id").alias("src")), found.select(F.col("e").alias("t"), F.col("id").alias("dst"))
    keyed = relations.withColumn("s", F.lower("source_entity")).withColumn("t", F.lower("target_entity"))
    return keyed.join(a.hint("merge"), "s").join(b.hint("merge"), "t").where("src != dst").select("src", "dst", F.col("relationship_type").alias("relationship"), "source_document", "confidence")


def containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(n, e): every distinct name ``n`` with every distinct text ``e`` that it contains.

    An index of the names' pieces of up to ``GRAM`` characters is met by the rarest piece of each text, then checked whole;
    an empty text is in no name.
    """
    names, parts = names.select("n").distinct(), parts.where("length(e) > 0").select("e").distinct()
    piece = lambda c, size: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, size))
    sizes = [piece("n", F.lit(k)) for k in range(1, GRAM + 1)]
    index = names.select("n", F.explode(F.array_distinct(F.concat(*sizes))).alias("gram"))
    asked = parts.select("e", F.explode(F.array_distinct(piece("e", F.least(F.length("e"), F.lit(GRAM))))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n_names"))
    rare = asked.join(often.hint("merge"), "gram", "left").groupBy("e").agg(F.min(F.struct(F.coalesce("n_names", F.lit(0)).alias("n_names"), "gram"))["gram"].alias("gram"))
    return index.join(rare.hint("merge"), "gram").where(F.contains("n", "e")).select("n", "e")


def nodes_of(edges: DataFrame) -> DataFrame:
    """(id, name, type) of all edge ends named ``type:name``."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ids.select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("name"), F.split_part("id", F.lit(":"), F.lit(1)).alias("type"))


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """num_nodes, num_edges, density, num_components, is_connected in one row."""
    n, m = nodes.agg(F.count("*").alias("num_nodes")), edges.agg(F.count("*").alias("num_edges"))
    linked = components(edges).agg(F.count_distinct("component").alias("c"), F.count("*").alias("k"))
    row = n.crossJoin(m).crossJoin(linked)  # one row each
    density = F.round(F.coalesce(F.try_divide(F.col("num_edges").cast("double"), F.col("num_nodes") * (F.col("num_nodes") - 1)), F.lit(0.0)), 10)
    total = F.col("c") + F.col("num_nodes") - F.col("k")
    return row.select("num_nodes", "num_edges", density.alias("density"), total.alias("num_components"), (total == 1).alias("is_connected"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, top: int | None = 10) -> DataFrame:
    """In and out edges over (n - 1), parallel edges counted, with distinct successors; the best ``top``."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("o")).unionAll(edges.select(F.col("dst"), F.lit(None).cast("string")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"), F.count_distinct("o").alias("num_connections"))
    n = nodes.agg(F.count("*").alias("n"))
    full = nodes.join(degree, "id", "left").crossJoin(F.broadcast(n))
    d = F.coalesce("degree", F.lit(0))
    out = full.select("id", d.alias("degree"), F.coalesce("num_connections", F.lit(0)).alias("num_connections"), F.round(F.coalesce(F.try_divide(d.cast("double"), F.col("n") - 1), F.lit(0.0)), 8).alias("centrality"))
    return out if top is None else out.orderBy(F.desc("centrality"), "id").limit(top)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, label, n: nodes by type and edges by relationship."""
    a = nodes.groupBy("type").count().select(F.lit("entity").alias("kind"), F.col("type").alias("label"), F.col("count").alias("n"))
    return a.unionAll(edges.groupBy("relationship").count().select(F.lit("relationship"), "relationship", "count"))


def search_entities(nodes: DataFrame, queries: DataFrame, limit: int = 10, types: list[str] | None = None) -> DataFrame:
    """(query, id, score, rank): nodes, of the given types if any, whose name contains the query; 1.0 if equal, else 0.8."""
    nodes = nodes if types is None else nodes.where(F.col("type").isin(types))
    low = nodes.select("id", "name", F.lower("name").alias("n"))
    asked = queries.select("query", F.lower("query").alias("e"))
    hit = containing(low, asked).join(low.hint("merge"), "n").join(asked.hint("merge"), "e")
    scored = hit.select("query", "id", F.when(F.lower("name") == F.lower("query"), 1.0).otherwise(0.8).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def entity_relationships(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges out of and into the chosen nodes: id, other, relationship, direction, context cut to 200."""
    c = chosen.select("id").distinct()
    cut = F.substring("context", 1, 200).alias("context")
    out = edges.join(c, edges["src"] == c["id"]).select("id", F.col("dst").alias("other"), "relationship", F.lit("outgoing").alias("direction"), cut)
    return out.unionAll(edges.join(c, edges["dst"] == c["id"]).select("id", F.col("src").alias("other"), "relationship", F.lit("incoming").alias("direction"), cut))


def relation_distribution(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    return entity_relationships(edges, chosen).groupBy("id", "relationship").agg(F.count("*").alias("n"))


def find_paths(edges: DataFrame, pairs: DataFrame, max_length: int = 3, per_pair: int | None = 5, total: int | None = None, multi: bool = False) -> DataFrame:
    """Simple paths of at most ``max_length`` edges between pairs (start, goal): start, goal, length, path.

    Parallel edges count once unless ``multi``; repeated pairs count once.
    """
    found = meeting_paths(edges, pairs, max_length, multi)
    out = found.select("start", "goal", (F.size("nodes") - 1).alias("length"), F.array_join("nodes", " > ").alias("path"))
    if per_pair is not None:
        w = Window.partitionBy("start", "goal").orderBy("length", "path")
        out = out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_pair).drop("r")
    return out if total is None else out.orderBy("length", "path").limit(total)


def meeting_paths(edges: DataFrame, pairs: DataFrame, max_length: int = 3, multi: bool = False) -> DataFrame:
    """All simple paths of at most ``max_length`` edges between pairs (start, goal): start, goal, nodes.

    Frontiers grow from the distinct starts and, against the edges, from the distinct goals, until an edge is left between
    them. Only edges from a tip of one frontier to a tip of the other stand in the middle, so no hub is opened towards
    nodes that lead to no goal. Parallel edges count once unless ``multi``.
    """
    ends = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).where("at is not null and to is not null and at <> to")
    step = stored(ends if multi else ends.distinct(), "steps")
    asked = stored(pairs.select("start", "goal").distinct(), "asked")
    ahead = [asked.select("start", F.array("start").alias("nodes"), F.col("start").alias("tip")).distinct()]
    behind = [asked.select("goal", F.array("goal").alias("tail"), F.col("goal").alias("first")).distinct()]
    for _ in range(max_length // 2):
        grown = ahead[-1].join(step.hint("merge"), F.col("tip") == F.col("at")).where(~F.array_contains("nodes", F.col("to")))
        ahead.append(stored(grown.select("start", F.array_append("nodes", F.col("to")).alias("nodes"), F.col("to").alias("tip")), "ahead"))
    for _ in range((max_length - 1) // 2):
        grown = behind[-1].join(step.hint("merge"), F.col("first") == F.col("to")).where(~F.array_contains("tail", F.col("at")))
        behind.append(stored(grown.select("goal", F.array_prepend("tail", F.col("at")).alias("tail"), F.col("at").alias("first")), "behind"))
    out = None
    for length in range(1, max_length + 1):
        a, b = ahead[length // 2], behind[(length - 1) // 2]
        tips = a.select(F.col("tip").alias("at")).distinct()
        middle = step.join(tips.hint("merge"), "at", "left_semi")
        closing = middle.join(b.hint("merge"), F.col("to") == F.col("first")).select("at", "goal", "tail")
        met = a.join(closing.hint("merge"), F.col("tip") == F.col("at")).where(~F.arrays_overlap("nodes", "tail"))
        found = met.select("start", "goal", F.concat("nodes", "tail").alias("nodes")).join(asked.hint("merge"), ["start", "goal"], "left_semi")
        out = found if out is None else out.unionAll(found)
    return out


def named_paths(nodes: DataFrame, edges: DataFrame, names: DataFrame, max_length: int = 3, per_pair: int = 5, total: int = 10) -> DataFrame:
    """Paths between entities whose names contain a start and a goal text: start_name, goal_name, rank, length, path.

    The shortest ``per_pair`` of each two nodes, and of those ``total`` for each row of names; ties by the path. Null and
    empty texts match nothing, and no path leads from a node to itself.
    """
    low = nodes.select("id", F.lower("name").alias("n"))
    asked = names.select("start_name", "goal_name").distinct()

    def matches(text: str, out: str) -> DataFrame:
        found = containing(low, asked.select(F.lower(text).alias("e"))).join(low.hint("merge"), "n")
        return found.select(F.col("e").alias(f"__{out}"), F.col("id").alias(out))

    starts = asked.join(matches("start_name", "start").hint("merge"), F.lower("start_name") == F.col("__start"))
    pairs = starts.join(matches("goal_name", "goal").hint("merge"), F.lower("goal_name") == F.col("__goal")).where("start <> goal").select("start_name", "goal_name", "start", "goal")
    pairs = stored(pairs, "pairs")
    paths = meeting_paths(edges, pairs, max_length).select("start", "goal", (F.size("nodes") - 1).alias("length"), F.array_join("nodes", " > ").alias("path"))
    first = F.row_number().over(Window.partitionBy("start", "goal").orderBy("length", "path"))
    best = paths.withColumn("r", first).where(F.col("r") <= per_pair).drop("r")
    rank = F.row_number().over(Window.partitionBy("start_name", "goal_name").orderBy("length", "path"))
    return pairs.join(best.hint("merge"), ["start", "goal"]).withColumn("rank", rank).where(F.col("rank") <= total).select("start_name", "goal_name", "rank", "length", "path")


def entity_clusters(edges: DataFrame, top: int = 5) -> DataFrame:
    """The largest components of more than one node: component, size."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return sizes.orderBy(F.desc("size"), "component").limit(top)


def semantic_entities(near: DataFrame, nodes: DataFrame, query_key: str, limit: int = 10) -> DataFrame:
    """Entities whose sources hold a chunk near the query, the nearest chunk first, each entity once.

    near: (query_key, source, score); nodes: (id, name, type, source), one row per source.
    """
    met = near.join(nodes.hint("merge"), "source")
    best = met.groupBy(query_key, "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


def related_by_context(near: DataFrame, nodes: DataFrame, reference: DataFrame, query_key: str, limit: int = 10) -> DataFrame:
    """Entities met near the context of a reference node, without the node itself.

    near: (query_key, source, score) of the chunks near each reference's context; reference: (query_key, id).
    """
    own = reference.select(query_key, "id")
    met = near.join(nodes.hint("merge"), "source").groupBy(query_key, "id").agg(F.max("score").alias("score")).join(own.hint("merge"), [query_key, "id"], "left_anti")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


def semantic_paths(ranked: DataFrame, edges: DataFrame, query_key: str, first: int = 5, pool: int = 10, per_pair: int = 2) -> DataFrame:
    """Paths between the first five of an entity ranking and later ones of the best ten; the score is the mean of both."""
    top = ranked.where(F.col("rank") <= pool)
    a = top.where(F.col("rank") <= first).select(query_key, F.col("id").alias("start"), F.col("rank").alias("ra"), F.col("score").alias("sa"))
    b = top.select(query_key, F.col("id").alias("goal"), F.col("rank").alias("rb"), F.col("score").alias("sb"))
    pairs = a.join(b.hint("merge"), query_key).where("ra < rb")
    paths = find_paths(edges, pairs.select("start", "goal").distinct(), per_pair=per_pair)
    return pairs.join(paths.hint("merge"), ["start", "goal"]).select(query_key, "start", "goal", "length", "path", F.round((F.col("sa") + F.col("sb")) / 2, 6).alias("score"))


def graph_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON row: metrics, counts by type and the most central nodes. Nodes and edges are read several times, so they are best stored."""
    types = nodes.groupBy("type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("entities"))
    central = degree_centrality(nodes, edges).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("centrality")).alias("c"), "id"))), lambda x: x["id"]).alias("top_central"))
    whole = graph_metrics(nodes, edges).crossJoin(types).crossJoin(central)  # one row each
    return whole.select("num_nodes", "num_edges", F.to_json(F.struct("num_nodes", "num_edges", "density", "is_connected", "entities", "top_central")).alias("metadata"))


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON row per node and edge for a viewer, nulls filled."""
    filled = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", filled("name", "unknown"), filled("type", "unknown"))).alias("row"))
    return a.unionAll(edges.select(F.lit("edge"), F.to_json(F.struct("src", "dst", filled("relationship", "unknown")))))
