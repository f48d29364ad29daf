"""Hand-made cases: hits and misses, nulls, ties, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.components import connected_components
from foliant.functions.shared import global_rank
from foliant.operators import checklist, entities, graph, legal, resolve, text, vectors
from foliant.sources import files

LEGAL = (
    'THIS SERVICES AGREEMENT ("Agreement") is made between Summit Digital Inc, a Delaware corporation ("Company"), and Harbor Holdings Ltd (the "Client"). '
    '"Closing Date" shall mean the day of payment. Jane Smith serves as CFO of the Company and reported annual revenue of $12 million. Granite acquired Harbor. Contact: info@mail3.com.'
)
MISS = "nothing of note stands in this line, 5 apples and no names at all"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("a.txt", 0, LEGAL), ("b.txt", 0, MISS), ("c.txt", 0, ""), ("d.txt", 0, None)], "source string, pos int, text string")


def test_recursive_chunks_keep_the_text():
    body = "\n\n".join(f"Paragraph {i}. " + "word " * 90 for i in range(12))
    out = text.split_recursive(body, 1000, 200)
    assert all(len(c) <= 1000 for c in out) and "".join(body.split()) != ""
    assert {w for c in out for w in c.split()} == set(body.split())
    assert text.split_recursive("") == [] and text.split_recursive("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 500]


def test_fixed_chunks_rebuild_the_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(3210))
    rows = text.chunk_fixed(spark.createDataFrame([(1, body), (2, ""), (3, "short")], "id long, text string"), "id").orderBy("id", "pos").collect()
    parts = [r.chunk for r in rows if r.id == 1]
    assert parts[0] + "".join(p[200:] for p in parts[1:]) == body
    assert [r.chunk for r in rows if r.id == 3] == ["short"]
    with pytest.raises(ValueError):
        text.chunk_fixed(spark.createDataFrame([(1, "")], "id long, text string"), "id", size=5, overlap=5)


def test_spans_name_their_place(spark):
    rows = text.regex_spans(spark.createDataFrame([(1, "é ab ab1 cab"), (2, "none"), (3, None)], "id long, text string"), "text", r"a(b)", 1).collect()
    assert [(r.id, r.start, r.end, r.match, r.g1) for r in rows] == [(1, 2, 4, "ab", "b"), (1, 5, 7, "ab", "b"), (1, 10, 12, "ab", "b")]


def test_spans_are_linear(spark):
    import time

    began = time.time()
    assert text.regex_spans(spark.createDataFrame([(1, "ab " * 70_000)], "id long, text string"), "text", "ab").count() == 70_000
    assert time.time() - began < 60


def test_excerpts(spark):
    df = spark.createDataFrame([("x" * 150 + " Needle " + "y" * 400,), ("no hit",)], "t string")
    got = [r[0] for r in df.select(text.best_excerpt(F.col("t"), F.lit("needle"))).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and "Needle" in got[0] and len(got[0]) == 406 and got[1] == "no hit"


def test_entities(chunks):
    names = {(r.source, r.name, r.jurisdiction) for r in entities.extract_companies(chunks).collect()}
    assert {n for s, n, _ in names if s == "a.txt"} >= {"Summit Digital Inc", "Harbor Holdings Ltd"} and not any(s != "a.txt" for s, *_ in names)
    person = entities.extract_people(chunks).collect()
    assert ("Jane Smith", "Jane", None, "Smith", "CFO") in [(r.name, r.first_name, r.middle_name, r.last_name, r.title) for r in person]
    money = entities.extract_financials(chunks).collect()
    assert [(r.name, r.amount, r.currency, r.metric, r.period) for r in money] == [("$12 million", 12e6, "$", "revenue", "annual")]
    found = [(r.source_entity, r.target_entity, r.relationship_type) for r in entities.extract_relations(chunks).where("source = 'a.txt'").collect()]
    assert ("Granite", "Harbor", "ACQUIRED") in found and {t for *_, t in found} == {"ACQUIRED", "EXECUTIVE_OF"}
    assert {r.entity_type for r in entities.extract_rich_entities(chunks).collect()} == {"companies", "people", "financial_metrics"}


@pytest.mark.parametrize(
    ("said", "pair"),
    [
        ("Granite Group purchased the Harbor Company", ("Granite Group", "Harbor Company", "ACQUIRED")),
        ("Granite partnered with Cedar Foods", ("Granite", "Cedar Foods", "PARTNERSHIP")),
        ("Summit invested in Cedar and others", ("Summit", "Cedar", "INVESTED_IN")),
        ("Jane Smith is the CEO of Summit", ("Jane Smith is the", "Summit", "EXECUTIVE_OF")),
        ("Omar Khan established Northwind", ("Omar Khan", "Northwind", "FOUNDED")),
        ("Granite controls Harbor", ("Granite", "Harbor", "OWNS")),
        ("Harbor Ltd, a firm; Cedar subsidiary of Granite", ("Cedar", "Granite", "SUBSIDIARY_OF")),
        ("nobody acquired", None),
    ],
)
def test_relation_types(spark, said, pair):
    c = spark.createDataFrame([("s", 0, f"{said}. " + "Some more words that stand behind it here."), ("t", 0, f"{said}.")], "source string, pos int, text string")
    got = [(r.source_entity, r.target_entity, r.relationship_type) for r in entities.extract_relations(c).where("source = 's'").collect()]
    assert got == ([pair] if pair else [])


def test_company_attributes(spark):
    body = "Business: marine freight.\nCedar Marine Services is headquartered in Oslo, has 1,200 employees and revenue of $12 million. Omar Khan, Vice President, works in Sales."
    c = spark.createDataFrame([("s", 0, body)], "source string, pos int, text string")
    r = {x.name: x for x in entities.extract_companies(c).collect()}["Cedar Marine Services"]
    assert (r.industry, r.location, r.employees, r.revenue) == ("marine freight", "Oslo", "12", "12 million")
    assert "Omar Khan" in {x.name for x in entities.extract_people(c).collect()}


@pytest.mark.parametrize(
    ("said", "term", "name", "kind"),
    [
        ('"Fee" means the price, as paid.', "fee", "the price", "quoted_definition"),
        ("Net Price means the sum due.", "net price", "the sum due", "unquoted_definition"),
        ("Work Product includes all drafts;", "work product", "all drafts", "unquoted_definition"),
        ("As used herein, Site refers to the yard.", "site", "the yard", "contextual_definition"),
        ("THIS LEASE (the \"Contract\")", "contract", "LEASE", "document_reference"),
        ("made between Granite and Harbor.", "granite", "Granite", "party_reference"),
        ("Losses (as defined in Section 3.1)", "losses", "Losses", "section_reference"),
        ("the TERM means one year.", "term", "one year", "capitalized_term"),
    ],
)
def test_definition_patterns(spark, said, term, name, kind):
    got = legal.all_definitions(spark.createDataFrame([("s", f"x {said} y"), ("t", "no term here")], "source string, text string")).collect()
    assert (term, name, kind) in {(r.keyword, r.canonical_name, r.pattern_type) for r in got} and {r.source for r in got} == {"s"}


@pytest.mark.parametrize(("name", "clean"), [("The Harbor and others", "Harbor"), ("an Apple, Inc", "Apple"), ("Granite", "Granite"), ("by X; Y", "X"), ("a b or c, d", "b")])
def test_clean_names(spark, name, clean):
    assert spark.createDataFrame([(name,)], "n string").select(entities.clean_entity_name(F.col("n"))).first()[0] == clean


def test_ner_takes_a_callers_tagger(chunks):
    def tagger():
        return lambda texts: [[("Summit", "ORG", 0.9), ("Jane", "PER", 0.8), ("low", "ORG", 0.1), ("x", "LOC", 0.99)] for _ in texts]

    got = entities.ner_entities(chunks.where("source = 'a.txt'"), tagger).collect()
    assert sorted((r.name, r.entity_type) for r in got) == [("Jane", "people"), ("Summit", "companies")]


def test_definitions(chunks):
    got = {r.keyword: r for r in legal.extract_definitions(chunks).where("source = 'a.txt'").collect()}
    assert {k: (r.canonical_name, r.keyword_type) for k, r in got.items()} == {
        "agreement": ("THIS SERVICES AGREEMENT", "document"),
        "company": ("Summit Digital Inc", "entity"),
        "client": ("Harbor Holdings Ltd", "entity"),
        "closing date": ("the day of payment", "other"),
        "delaware corporation": ("Summit Digital Inc", "other"),
    }
    assert got["closing date"].confidence == 1.0
    assert all(0 < r.confidence <= 1 for r in got.values())
    done = {r.source: r for r in legal.process_chunks(chunks).collect()}
    assert "CFO of the Summit Digital Inc" in done["a.txt"].text and done["a.txt"].replaced and not done["b.txt"].replaced


def test_replacement_is_whole_word_longest_first(spark):
    c = spark.createDataFrame([("s", "the Client and the client companies; Client Group, Clients")], "source string, text string")
    d = spark.createDataFrame([("s", "Client", "A$B", "entity"), ("s", "Client Group", r"C\D", "entity"), ("s", "the", "no", "other")], "source string, keyword string, canonical_name string, keyword_type string")
    assert legal.replace_keywords(c, d).first().text == r"the A$B and the A$B companies; C\D, Clients"


def test_malformed_legal_text_gives_nothing(spark):
    c = spark.createDataFrame([("s", 'open ("quote and (bracket "" () ("")'), ("t", "(" * 5000 + '"' * 5001)], "source string, text string")
    assert legal.all_definitions(c).count() == 0


def brute_average_linkage(x, limit):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    d, groups = 1 - unit @ unit.T, [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min(((round(float(np.mean(d[np.ix_(a, b)])), 9), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if not best[0] < limit:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage_is_exact(spark):
    r = np.random.default_rng(4)
    for n in (2, 15, 40):
        centres = r.standard_normal((5, 6))
        x = centres[r.integers(0, 5, n)] + 0.6 * r.standard_normal((n, 6))
        df = spark.createDataFrame([(int(i), "t", v.tolist()) for i, v in enumerate(x)], "id long, entity_type string, vec array<double>")
        limit = F.lit(0.7)
        got = resolve.cluster_entities(df, resolve.similar_pairs(df, ["entity_type"], limit), limit).collect()
        groups = {}
        for row in got:
            groups.setdefault(row.cluster, set()).add(row.id)
        assert {frozenset(g) for g in groups.values()} == brute_average_linkage(x, 0.3)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*chain, *star, (5, 5), (None, 7)], "a long, b long")).collect()}
    assert len(got) == 301 + 400 and set(got.values()) == {0, 1000} and got[300] == 0 and got[1399] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank_has_no_gaps(spark):
    got = global_rank(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), [F.col("v")]).collect()
    assert all(r.v == r["rank"] for r in got)


def test_paths_do_not_revisit(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "b")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "c")], "start string, goal string")
    assert sorted(r.path for r in graph.find_paths(edges, pairs).collect()) == ["a > b > c", "a > c"]
    assert graph.find_paths(edges, pairs, multi=True).count() == 3


def test_graph_metrics_formula(spark):
    edges = spark.createDataFrame([("x:a", "x:b", "r"), ("x:b", "x:c", "r")], "src string, dst string, relationship string")
    row = graph.graph_metrics(graph.nodes_of(edges), edges).first()
    assert (row.num_nodes, row.num_edges, round(row.density, 6), row.is_connected) == (3, 2, round(2 / 6, 6), True)
    top = graph.degree_centrality(graph.nodes_of(edges), edges).first()
    assert (top.id, top.centrality) == ("x:b", 1.0)


def test_edges_by_name(spark):
    nodes = spark.createDataFrame([("c:Acme", "Acme"), ("c:Acme Corp", "Acme Corp"), ("c:Bolt", "Bolt")], "id string, name string")
    rel = spark.createDataFrame([("acme", "BOLT", "owns", "d", 1.0), ("Bolt", "Bolt", "owns", "d", 1.0)], "source_entity string, target_entity string, relationship_type string, source_document string, confidence double")
    assert [(r.src, r.dst) for r in graph.build_edges(nodes, rel).collect()] == [("c:Acme", "c:Bolt")]
    assert graph.build_edges(nodes, rel, "contains").count() == 2


def test_parse_questions_carries_the_category_down(spark):
    md = "# Title\n\n## A. Corporate \\& Legal\n\t1. What is the company’s name?\n2. Second question here\nplain\n### B. **Finance**\n1. Third question here\n"
    got = checklist.parse_questions(spark.createDataFrame([("f.md", md)], "file string, text string")).orderBy("id").collect()
    assert [(r.id, r.category, r.question) for r in got] == [("A.1", "Corporate & Legal", "What is the company's name?"), ("A.2", "Corporate & Legal", "Second question here"), ("B.1", "Finance", "Third question here")]


def test_few_candidates_keep_all(spark):
    m = spark.createDataFrame([(1, i, 0.1 * i) for i in range(4)] + [(2, i, 0.9 if i == 0 else 0.1) for i in range(10)], "item_no int, vec_id int, score double")
    got = checklist.significant_matches(m).collect()
    assert len([r for r in got if r.item_no == 1]) == 4 and [r.vec_id for r in got if r.item_no == 2] == [0]


def test_knn_breaks_ties_by_key(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(99, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vec array<float>")
    assert sorted(r.vec_id for r in vectors.knn_l2(v.repartition(4), q, 3).collect()) == [0, 1, 2]
    assert vectors.knn_l2(v, q.limit(0), 3).count() == 0


def test_rooms_round_trip(spark, tmp_path):
    (tmp_path / "p" / "Room One").mkdir(parents=True)
    (tmp_path / "p" / "Room One" / "a_b-c.txt").write_text("hello é")
    (tmp_path / "p" / "Room One" / "x.bin").write_bytes(b"\0")
    rows = files.scan_data_room(spark, str(tmp_path)).collect()
    assert [(r.path.replace("%20", " "), r.name, r.text) for r in rows] == [("p/Room One/a_b-c.txt", "a_b-c.txt", "hello é")]
    assert files.list_files(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="(?i)not"):
        files.scan_data_room(spark, str(tmp_path / "missing")).count()


def test_prebuilt_names_what_there_is(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "file string, n int").write.parquet(str(tmp_path / "t"))
    assert files.read_prebuilt(spark, str(tmp_path / "t"), "a").count() == 1
    with pytest.raises(ValueError, match=r"there are \['a', 'b'\]"):
        files.read_prebuilt(spark, str(tmp_path / "t"), "c")


def test_plans_prune_and_stay_in_the_jvm(spark, sf, capsys):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text.mark_first_chunk(text.chunk_fixed(docs.where("lang = 'en'").select("doc_id", "text"), "doc_id"), "doc_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "EqualTo(lang,en)" in plan and "n_chars" not in plan


def test_containing_against_brute_force(spark):
    names = ["abcabc", "bca", "a", "", "zz", "ab", "supplier#1", "supplier#12", "\u00e9t\u00e9", None]
    parts = ["abc", "a", "", "supplier#1", "r#1", "\u00e9", "zzz", "bc", None]
    got = graph.containing(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(p,) for p in parts + parts], "e string"))
    want = {(n, p) for n in names if n for p in parts if p and p in n}
    assert sorted((r.n, r.e) for r in got.collect()) == sorted(want)


def test_similar_pairs_in_cells_are_those_of_the_whole_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, entity_type string, vec array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if rows[i][1] == rows[j][1] and round(float(unit[i] @ unit[j]), 6) >= 0.7}
    monkeypatch.setattr(resolve, "CELL", 7)
    got = [(r.a, r.b) for r in resolve.similar_pairs(df, ["entity_type"], F.lit(0.7)).collect()]
    assert sorted(got) == sorted(want)


def test_paths_look_up_the_last_edge(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "a"), ("d", "a")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "d"), ("d", "c"), ("b", "b")], "start string, goal string")
    got = graph.find_paths(edges, pairs, max_length=3).collect()
    assert sorted(r.path for r in got) == ["a > b > c > d", "a > c > d", "d > a > b > c", "d > a > c"]
