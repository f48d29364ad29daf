"""How the work of queries grows: tasks by rows, each step worked out once."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.functions import shared
from foliant.operators import entities, legal, resolve, sparse, text, vectors
from foliant.plans import corpora, entity_queries, graph_queries, registry, search_queries  # noqa: F401
from foliant.streaming.index import SparseIndex
from tests import test_features
from tests.test_oracle import canonical


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def agreements(spark):
    text = 'The agreement of Summit Marine Inc, a Delaware corporation (the "Client"). "Closing Date" shall mean the day.'
    return spark.range(40).select(F.concat("id", F.lit(".txt")).alias("source"), F.lit(0).alias("pos"), F.lit(text).alias("text"))


def test_tasks_grow_with_the_texts(spark, sf, agreements, monkeypatch):
    monkeypatch.setattr(shared, "TEXTS_OF_TASK", 4)
    assert legal.extract_definitions(agreements).rdd.getNumPartitions() == 10
    monkeypatch.setattr(shared, "TEXTS_OF_TASK", 100)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert corpora.corpus(spark, sf, "legal").rdd.getNumPartitions() == -(-orders // 100)


def test_definitions_are_read_once(agreements):
    found = legal.extract_definitions(agreements)
    both = legal.keyword_entities_and_relations(found)
    assert plan(both).count("posexplode") == plan(legal.keyword_relations(found)).count("posexplode") == 1
    assert both.groupBy("kind", "type").count().sort("kind", "type").collect() == [("entity", "legal_keywords", 120), ("relation", "defined_in", 120), ("relation", "refers_to", 40)]


def test_terms_are_replaced_once(spark, agreements, monkeypatch):
    """Tasks grow with the texts, a text is put together once, and it is not carried to its places."""
    monkeypatch.setattr(shared, "TEXTS_OF_TASK", 4)
    done = legal.process_chunks(agreements)
    assert done.rdd.getNumPartitions() == 10
    assert plan(done).count("zip_with") == 1
    assert {(r.replaced, r.text) for r in done.collect()} == {(True, agreements.first().text.replace('"Client"', '"Summit Marine Inc"'))}
    found = legal.arrow_spans(agreements.select("source", "text"), "text", legal.ANCHOR, 5, 5)
    assert found.columns == ["source", "match", "start", "end", "before", "behind"]


def test_bracket_over_two_lines(spark):
    c = spark.createDataFrame([("s", 'Summit Marine Inc (the\n"Client") pays')], "source string, text string")
    assert [(r.keyword, r.canonical_name) for r in legal.all_definitions(c).collect()] == [("client", "Summit Marine Inc")]


DEFINING = [
    'Granite Inc, an Ohio company ("Buyer"), and\nHarbor Ltd, a  Nevada\tcorporation (the "Seller"). THIS LEASE ("Lease") between Anna and Karl',
    'x, " (a ) , a ("One"); (the "Two") () , an ("Three") "" ("Four")', "THE NEXT\n(\"Five\") THIS\nDEED OF\n(\"Six\")",
    '"Term" shall mean the day; The Fee refers to a sum, the FULL FEE means all of it. the A B includes more than one of it. Term\nmeans this Deed (x and y).',
    "As used herein, The Goods means what is sold. For purposes of this Lease, Rent Due refers to a sum:", "Title Of (as defined in Section 1.2) shall refer to none, and Other (as\ndefined in Section 9)",
    'Caf\u00e9 R\u00f4ti ("Caf\u00e9 \u20ac"), "Z\u00fcrich" means \u00e9t\u00e9, for purposes of this. \U0001f600 Nordic A&B ("N") ("NN")', 'the ("Any") such ("The") Fir_m Name9 & Co ("Co Name...")', "", None, "nothing",
]


def test_definitions_are_read_by_arrow(spark, sf, agreements, tmp_path):
    """No pattern is tried by the JVM, and what the SQL gives comes out."""
    found = legal.all_definitions(agreements)
    assert "regexp" not in plan(found) and "RLIKE" not in plan(found)
    con = duckdb.connect()
    pd.DataFrame({"doc_id": range(len(DEFINING)), "text": DEFINING, "lang": "en", "source": "web", "n_chars": 0}).to_parquet(tmp_path / "documents.parquet")
    pd.read_parquet(f"{sf}/orders.parquet").head(9).to_parquet(tmp_path / "orders.parquet")
    for t in ("documents", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("all_definitions", "extract_definitions"):
        a, b = canonical(registry.QUERIES[name](spark, str(tmp_path)).toPandas()), canonical(con.sql(registry.ORACLES[name]).df())
        assert a.source.str.startswith("note").sum() >= 18
        pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_names_are_followed_back_once(agreements):
    assert plan(entities.extract_companies(agreements)).count(entities.LAST_RUN) == 1


ODD = ["é Inc Inc1 cInc äInc Inc, Co", "Inc\u0301 Ltd\u20ac LLC\u00a0Corp \U0001d400Inc \U0001f600 Inc", "§Inc§ Co\x01\x02Co", "_Inc Co_ \n Company\r\nLtd.", "none", "", None, "Inc"]


@pytest.mark.parametrize("at_once", [1024, 3])
def test_arrow_finds_the_same_places(spark, monkeypatch, at_once):
    monkeypatch.setattr(text, "TEXTS_AT_ONCE", at_once)
    rows = spark.createDataFrame(list(enumerate(ODD * 3)), "id int, t string")
    for pattern in (entities.CLOSING, legal.ANCHOR, "I"):
        found = text.arrow_spans(rows, "t", pattern, 3, 4).collect()
        assert sorted((r.id, r.match, r.start, r.end) for r in found) == sorted((r.id, r.match, r.start, r.end) for r in text.regex_spans(rows, "t", pattern).collect())
        texts = dict(enumerate(ODD * 3))
        assert all((r.before, r.behind) == (texts[r.id][max(0, r.start - 3) : r.start], texts[r.id][r.end : r.end + 4]) for r in found)
    assert text.arrow_spans(rows.where("false"), "t", "I", 3, 4).count() == 0


def test_companies_are_read_by_arrow(spark, agreements):
    """No pattern of an attribute or a closing word is tried by the JVM, and what its patterns give comes out."""
    found = entities.extract_companies(agreements)
    assert all(word not in plan(found) for word in ("headquartered", "Technologies", "regexp_extract_all"))
    odd = spark.createDataFrame([("s", f"Granite Inc{t} Revenue was $5 million, based in Rom\u00e9, state: Ohio; 30 staff, a Delaware corporation (the \"Buyer\") a@b.com") for t in (".", "\u00e4", " \u20ac", "\n", "")], "source string, text string")
    for rows in (found, entities.extract_companies(odd)):
        attributes = entities.ATTRIBUTES["company"]
        plain = rows.select(*[entities.first_attribute(F.col("context"), p).alias(a) for a, p in attributes.items()])
        assert rows.count() and sorted(rows.select(*attributes).collect(), key=str) == sorted(plain.collect(), key=str)


def test_cues_leave_no_attribute_out(spark):
    texts = [
        "Industry: Marine. REVENUE of $5 million, 40 staff, state: Delaware", "Specializes in boats; yearly sales: none, $3m yearly", "a leader in ropes, Nevada corp with 20-30 people",
        'an Ohio partnership (the "Lender"), incorporated in Ohio', '("Client") x@mail.com located in Rome, Limited', "workforce 12 INC", "business : none", "$7 annual, 5 employees", "focuses on sails, based in Oslo", "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, patterns in entities.ATTRIBUTES["company"].items():
        plain, cued = rows.select(entities.first_attribute(F.col("t"), patterns), entities.first_attribute(F.col("t"), patterns, F.lower("t"), entities.CUES["company"][name])).toPandas().T.values
        assert list(plain) == list(cued)
        assert any(plain)


def test_a_common_relation_is_not_gathered(agreements):
    said = agreements.withColumn("text", F.lit("It is known to all that Granite Holdings acquired Harbor Foods, and so on."))
    found = entities.dedup_relations(entities.extract_relations(said))
    assert "Window" not in plan(found)
    assert [(r.source, r.source_entity, r.target_entity, r.relationship_type) for r in found.collect()] == [("0.txt", "It is known to all that Granite Holdings", "Harbor Foods", "ACQUIRED")]


def test_edges_are_worked_out_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(graph_queries.graph, "graph_metadata", lambda nodes, edges: seen.append((nodes, edges)) or nodes.selectExpr("id as num_nodes", "name as num_edges", "'{}' as metadata"))
    graph_queries.graph_metadata(spark, sf)
    graph_queries.save_graph(spark, sf)
    assert len(seen) == 2
    assert not any("l_partkey" in plan(df) for pair in seen for df in pair)


@pytest.mark.parametrize("block", [2048, 50])
def test_pairs_worked_on_at_once(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "CELLS", 600)
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))

    def pick(q, x, keys):
        assert len(q) * len(x) <= 600
        at, found = np.nonzero(q[:, :1] == x[None, :, 0])
        return [at, found, keys[found].astype(float)]

    met = vectors._scan(rows, "vec_id", "embedding", rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id", "query_vec", "score", pick).collect()
    assert sorted(met) == [(i, i, float(i)) for i in range(200)]


def test_terms_of_a_document_are_counted_in_its_row(spark):
    rows = [(1, "b a b _b c"), (2, ""), (3, None), (4, "aa"), (5, "zz zz"), (6, "ÄÄ ää bb aa bb")]
    found = sparse.document_terms(spark.createDataFrame(rows, "id long, t string"), "id", F.filter(F.split("t", " "), lambda w: w != ""))
    assert "Aggregate" not in plan(sparse.each_term(found, "id"))
    have = {r.id: (r.dl, None if r.terms is None else dict(zip(r.terms, r.tfs, strict=True))) for r in found.collect()}
    assert have == {1: (5, {"a": 1, "b": 2, "_b": 1, "c": 1}), 2: (0, {}), 3: (None, None), 4: (1, {"aa": 1}), 5: (2, {"zz": 2}), 6: (5, {"ÄÄ": 1, "ää": 1, "bb": 2, "aa": 1})}


@pytest.mark.parametrize(("steps", "cells"), [(1 << 20, 1 << 21), (7, 60)])
def test_documents_meet_queries_within_a_task(spark, monkeypatch, steps, cells):
    """No pair of a query and a document is joined or grouped, and what joining the postings gives comes out."""
    monkeypatch.setattr(sparse, "STEPS", steps)
    monkeypatch.setattr(sparse, "CELLS", cells)
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(vocab, n, p=np.arange(25, 0, -1) / 325))
    docs = [(f"d{i}", text(int(rng.integers(0, 40)))) for i in range(150)] + [(f"copy{i}", "w20 w21 w22 w22") for i in range(60)] + [("none", None), ("Ω", "w24"), ("z", "w24")]
    asked = [(f"q{i}", text(6)) for i in range(20)] + [("copies", "w20 w21 w22"), ("rare", "w24 w24"), ("unknown", "other"), ("none", None)]
    d, a = spark.createDataFrame(docs, "doc string, text string").repartition(3), spark.createDataFrame(asked, "q string, text string")
    found = sparse.bm25_search(d, a, "doc", "q", top_k=4)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    monkeypatch.setattr(sparse, "HELD", 0)
    joined = sparse.bm25_search(d, a, "doc", "q", top_k=4)
    assert "Join" in plan(joined)
    assert sorted(found.collect()) == sorted(joined.collect())
    assert [r.doc for r in found.where("q = 'copies'").sort("rank").collect()] == ["copy0", "copy1", "copy10", "copy11"]


@pytest.mark.parametrize("most", [200_000, 0])
def test_only_texts_of_hits_are_moved(spark, sf, monkeypatch, most):
    monkeypatch.setattr(shared, "SENT", most)
    found = search_queries.rerank(spark, sf)
    scan = next(line for line in plan(found).split("\n") if "Join" in line and "doc_id" in line)
    assert ("broadcast" in scan) == (most > 0)
    assert found.count() == 10 * spark.read.parquet(f"{sf}/benchmark.parquet").count()


def test_hybrid_search_keeps_no_row_per_pair(spark, tmp_path, monkeypatch):
    """What is stored has a row per document or per word of an item, and only the hits of both sides are joined."""
    words = lambda i, n: " ".join(f"w{j}" for j in range(n) if (i + j) % 3 == 0)
    docs = [(i, f"{words(i, 12)} {'pad ' * (i % 5)}{words(i % 2, 6)}") for i in range(290)] + [(290, None), (291, ""), *((i, "w1 w2 w2") for i in range(292, 300))]
    asked = [(3 * i, " ".join(f"w{j}" for j in range(12) if (i + j) % 4)) for i in range(30)] + [(1, "unknown"), (2, None), (4, ""), (999, "w1 w2")]
    base = np.random.default_rng(3).normal(size=(40, 8)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1)[:, None]
    tables = {
        "documents": pd.DataFrame(docs, columns=["doc_id", "text"]),
        "benchmark": pd.DataFrame(asked, columns=["item_id", "text"]),
        "embeddings": pd.DataFrame({"vec_id": range(300), "embedding": [base[i % 40] for i in range(300)]}),
    }
    con = duckdb.connect()
    for name, rows in tables.items():
        rows.to_parquet(tmp_path / f"{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    kept, put = [], sparse.stored
    monkeypatch.setattr(sparse, "stored", lambda df, name: kept.append(put(df, name)) or kept[-1])
    found = search_queries.hybrid_search(spark, str(tmp_path))
    assert max(df.count() for df in kept) == 300
    assert plan(found).count("Join") == 1 and "Aggregate" not in plan(found)
    pd.testing.assert_frame_equal(canonical(found.toPandas()), canonical(con.sql(registry.ORACLES["hybrid_search"]).df()), check_dtype=False)


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (1, 400), (50, 400), (0, 300)])
def test_pruned_bm25_with_queries_that_no_task_holds(spark, monkeypatch, seed, n):
    monkeypatch.setattr(sparse, "HELD", 0)
    test_features.test_pruned_bm25_against_every_posting(spark, monkeypatch, seed, n)


def test_old_postings_are_not_joined(spark, tmp_path):
    """An index keeps one row of terms for a document, so a changed one costs a row and not a row for every term."""
    index = SparseIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(1, "alpha beta beta", 1), (2, "gamma", 1), (3, "alpha", 1)], "doc_id long, text string, version int"), 0)
    index.add(spark.createDataFrame([(1, "alpha", 2), (2, None, 2)], "doc_id long, text string, version int"), 1)
    assert sorted((r.doc_id, r.batch, r.terms, r.tfs) for r in index.live("words").collect()) == [(1, 1, ["alpha"], [1]), (3, 0, ["alpha"], [1])]
    assert index.table("words").count() == 5
    assert sorted(map(tuple, index.term_counts().collect())) == [("alpha", 2)]


@pytest.mark.parametrize("block", [2048, 20])
def test_a_matrix_is_moved_and_written_in_few_bytes(spark, monkeypatch, block):
    """Vectors stay as narrow as they came, and a vector's scores stand together."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    x = spark.range(90).coalesce(1).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    found = vectors.cosine_matrix(x, x.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")))
    assert "array<double>" not in plan(found)
    runs = found.rdd.mapPartitions(lambda rows: [[r.vec_id for r in rows]]).collect()
    assert sum(a != b for part in runs for a, b in zip(part, part[1:], strict=False)) < 600
    assert len({(r.query_id, r.vec_id) for r in found.collect()}) == found.count() == 8100


def plain_linkage(x, threshold):
    """Average linkage that looks at all distances for every merge, the first smallest one on ties."""
    unit = resolve.unit_rows(x)
    d = np.round(1 - unit @ unit.T, 9)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(len(x)), np.arange(len(x))
    for _ in range(len(x) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        if not d[i, j] < threshold:
            break
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


@pytest.mark.parametrize("n", [1, 2, 3, 30, 150])
def test_linkage_keeps_ties(n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=(n, 3)), rng.integers(0, 3, (n, 3)).astype(float), np.ones((n, 2)), np.repeat(rng.normal(size=(n, 4)), 2, axis=0)[:n], np.zeros((n, 2))):
        for threshold in (0.1, 0.5, 1.5):
            assert resolve.average_linkage(x, threshold).tolist() == plain_linkage(x, threshold).tolist()


def test_a_large_component_is_clustered(spark):
    """Over 5000 rows in one component; links grow with rows and not with pairs."""
    angle = np.concatenate([np.linspace(0, 0.3, 5200), [1.0, 1.01, 2.5]])
    df = spark.createDataFrame([(i, "t", [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "id long, entity_type string, vec array<double>").repartition(3)
    links = resolve.similar_links(df, ["entity_type"], F.lit(0.95))
    assert links.count() < 3 * len(angle)
    got = {r.id: r.cluster for r in resolve.cluster_entities(df, links, F.lit(0.95)).collect()}
    assert got == {i: 0 for i in range(5200)} | {5200: 5200, 5201: 5200, 5202: 5202}


@pytest.mark.parametrize(("batch", "cell", "product"), [(10_000, 1 << 15, 1 << 22), (3, 7, 20)])
def test_links_connect_what_pairs_do(spark, monkeypatch, batch, cell, product):
    for name, value in (("PIVOTED", cell), ("CELL", cell), ("PASSING", 40), ("PRODUCT", product)):
        monkeypatch.setattr(resolve, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = np.random.default_rng(5)
        x = np.concatenate([rng.normal(size=(30, 8))[rng.integers(0, 30, 90)] + 0.1 * rng.normal(size=(90, 8)), np.ones((60, 8)) + 0.02 * rng.normal(size=(60, 8))])
        df = spark.createDataFrame([(f"e{i}", "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id string, entity_type string, vec array<double>")
        limit = F.when(F.col("entity_type") == "a", 0.8).otherwise(0.9)
        pairs, links = ({(r.a, r.b): r.score for r in f(df, ["entity_type"], limit).collect()} for f in (resolve.similar_pairs, resolve.similar_links))
        assert links.items() <= pairs.items() and len(links) < len(pairs) / 2
        clusters = [sorted(resolve.cluster_entities(df, spark.createDataFrame(list(edges), "a string, b string"), limit).collect()) for edges in (pairs, links)]
        assert clusters[0] == clusters[1] and len(clusters[0]) == 150
        of = {}
        for i in range(150):
            of.setdefault(next((c for n, c in clusters[0] if n == f"e{i}")), set()).add(i)
        assert max(map(len, of.values())) >= 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_entities_are_resolved_by_links(spark, monkeypatch):
    """A large group of copies goes into the components with a link for a row."""
    seen = []
    monkeypatch.setattr(resolve, "connected_components", lambda edges, whole=resolve.connected_components: seen.append(edges.count()) or whole(edges))
    rows = spark.range(300).select("id", F.lit("people").alias("entity_type"), F.concat(F.lit("Name "), "id").alias("name"), F.lit("a.txt").alias("source"), F.lit("c").alias("context"), F.lit(0.5).alias("confidence"), F.lit("ner").alias("extraction_method"), F.array(F.lit(1.0), F.col("id") / 3000).alias("vec"))
    found = resolve.resolve_entities(rows).collect()
    assert [(r.cluster, r.cluster_size, r.name) for r in found] == [(0, 300, "Name 299")]
    assert seen and max(seen) < 300
