"""Fitted models against formulas, pair joins against brute force, one-pass replacement, paths, sinks and JSON."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from foliant.operators import checklist, classify, entities, features, graph, legal, reports, resolve, sparse, text, vectors
from foliant.sources import files


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def words(t):
    return [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if len(w) > 1]


DOCS = ["alpha beta beta", "beta gamma", "gamma gamma delta alpha", "", None, "epsilon"]


def test_default_vectors_follow_the_formulas(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id long, text string")
    got = {r.id: r.v for r in features.fit_text_vectors(df, dim=64)(df, "text", "v").collect()}
    place = HashingTF(numFeatures=64).indexOf
    tf = [Counter(place(w) for w in words(t)) for t in DOCS]
    df_ = Counter(i for c in tf for i in c)
    for i, c in enumerate(tf):
        want = np.zeros(64)
        for at, n in c.items():
            want[at] = n * math.log((len(DOCS) + 1) / (df_[at] + 1))
        want /= max(np.linalg.norm(want), 1e-300)
        assert np.allclose(got[i], want, atol=1e-6)


def test_naive_bayes_follows_the_formulas(spark):
    labelled = [("good clean alpha", 1), ("good beta clean clean", 1), ("junk spam spam", 0), ("spam beta", 0), ("alpha good", 1), ("left out", None), (None, 0)]
    df = spark.createDataFrame(labelled, "text string, label int")
    model = features.fit_text_classifier(df, dim=1 << 12)
    asked = ["good alpha", "spam spam beta", "", None, "unknown words here", "clean junk"]
    got = {r.id: (r.predicted, r.probability) for r in features.classify_texts(spark.createDataFrame(list(enumerate(asked)), "id long, text string"), model, "id").collect()}
    place = HashingTF(numFeatures=1 << 12).indexOf
    known = [(Counter(place(w) for w in words(t)), y) for t, y in labelled if y is not None]
    n = len(known)
    df_ = Counter(i for c, _ in known for i in c)
    idf = lambda i: math.log((n + 1) / (df_[i] + 1))
    total = {y: Counter() for y in (0, 1)}
    for c, y in known:
        for i, k in c.items():
            total[y][i] += k * idf(i)
    count = Counter(y for _, y in known)
    for at, t in enumerate(asked):
        score = {}
        for y in (0, 1):
            score[y] = math.log((count[y] + 1) / (n + 2))  # smoothed by 1, as the terms are
            for i, k in Counter(place(w) for w in words(t)).items():
                score[y] += k * idf(i) * math.log((total[y][i] + 1) / (sum(total[y].values()) + (1 << 12)))
        top = max(score, key=score.get)
        p = 1 / sum(math.exp(s - score[top]) for s in score.values())
        assert got[at][1] == pytest.approx(p, abs=2e-6)
        assert got[at][0] == str(top) or p == pytest.approx(0.5)


def test_classifier_on_held_out_documents(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = docs.join(labels, "doc_id")
    model = features.fit_text_classifier(rows.where(~held), label="quality")
    told = features.classify_texts(rows.where(held), model, "doc_id").join(labels, "doc_id").collect()
    right = sum(r.predicted == str(r.quality) for r in told) / len(told)
    most = max(Counter(r.quality for r in told).values()) / len(told)
    assert right > max(0.6, most - 0.05), (right, most)


def test_a_callers_classifier(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "yy")], "id long, text string")
    got = rows_of(classify.classify_with(df, "id", "text", lambda: lambda ts: [f" The document type is N{len(t)}" for t in ts]))
    assert got == [(1, "n1"), (2, None), (3, "n2")]


@pytest.mark.parametrize("least", [0.7, 0.9])
def test_lsh_recall_at_the_limit(spark, least):
    rng = np.random.default_rng(6)
    dim = 32
    a = rng.normal(size=(300, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=(300, dim))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = least + (1 - least) * rng.random(300) * 0.2  # near the limit
    b = cos[:, None] * a + np.sqrt(1 - cos**2)[:, None] * side
    df = lambda x, k, v: spark.createDataFrame([(int(i), r.tolist()) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * dim)], f"{k} long, {v} array<double>")
    va, vb = df(3 * a, "vec_id", "embedding"), df(b, "query_id", "query_vec")
    got = {(r.query_id, r.vec_id): r.score for r in features.lsh_cosine_pairs(va, vb, least, dim).collect()}
    want = {(r.query_id, r.vec_id): r.score for r in vectors.cosine_matrix(va, vb, least=least).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert len(want) >= 300 and len(got) / len(want) >= 0.9


@pytest.mark.parametrize("n", [10, 1000, 100_000, 10_000_000])
def test_unlike_vectors_share_few_places(n):
    bits, tables = features.planes(0.9, 0.95, n)
    assert n * tables / 2**bits < 32  # unlike rows that a row meets in all tables
    assert (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= 0.05


def test_copies_of_vectors_all_have_their_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 16))
    df = lambda ids, k, v: spark.createDataFrame([(i, x[i % 3].tolist()) for i in ids], f"{k} long, {v} array<double>")
    got = features.lsh_cosine_pairs(df(range(30), "vec_id", "embedding"), df(range(12), "query_id", "query_vec"), 0.99, 16)
    assert rows_of(got) == [(q, k, 1.0) for q in range(12) for k in range(30) if q % 3 == k % 3]


def clustered(rng, n, clusters, dim=12):
    x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, dim))
    x[: n // 8] = rng.normal(size=(n // 8, dim))  # some far from all
    x[n // 2 : n // 2 + n // 10] = x[n // 2]  # repeated rows
    return x


def test_pivot_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PIVOTED", 40)
    monkeypatch.setattr(resolve, "CELL", 30)
    monkeypatch.setattr(resolve, "PASSING", 150)
    monkeypatch.setattr(resolve, "PRODUCT", 100)
    rng = np.random.default_rng(8)
    for n, dim in ((30, 3), (600, 12)):
        x = clustered(rng, n, 9, dim)
        kinds = [("companies", "people", None)[int(k)] for k in rng.integers(0, 3, n)]
        df = spark.createDataFrame([(f"e{i:04d}", k, None if i % 50 == 7 else v.tolist()) for i, (k, v) in enumerate(zip(kinds, x, strict=True))], "id string, entity_type string, vec array<double>")
        limit = resolve.threshold_of(F.col("entity_type"))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        c = np.round(unit @ unit.T, 6)
        t = {"companies": 0.8, "people": 0.85, None: 0.8}
        want = [(f"e{i:04d}", f"e{j:04d}") for i in range(n) for j in range(i + 1, n) if kinds[i] == kinds[j] and i % 50 != 7 and j % 50 != 7 and c[i, j] >= t[kinds[i]]]
        got = [(r.a, r.b) for r in resolve.similar_pairs(df, ["entity_type"], limit).collect()]
        assert sorted(got) == sorted(want)


def test_pivots_send_far_fewer_rows_than_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PIVOTED", 100)
    rng = np.random.default_rng(9)
    sent = []
    for n in (500, 4000):
        # as many clusters as rows allow: a type's names repeat a few times each
        x = rng.normal(size=(n // 40, 6))[rng.integers(0, n // 40, n)] + 0.02 * rng.normal(size=(n, 6))
        df = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(x)], "id long, entity_type string, vec array<double>")
        sent.append(resolve.placed_rows(df, ["entity_type"], F.lit(0.9)).count())
    assert sent[1] / sent[0] < 8**1.6  # all pairs of cells: 8 ** 2
    assert sent[1] < 4000 * 40 / 2


def test_resolve_entities_of_all_types(spark):
    rows = [
        (1, "companies", "Summit Digital Inc", "a.txt", "Summit Digital Inc is a Delaware corporation that sells software", 0.8, "rich_pattern"),
        (2, "companies", "Summit Digital Inc", "b.txt", "Summit Digital Inc is a Delaware corporation that sells software", 0.9, "ner"),
        (3, "companies", "Harbor Holdings", "a.txt", "Harbor Holdings ships freight by sea", 0.9, "ner"),
        (4, "people", "Jane Smith", "a.txt", "Jane Smith serves as officer", 0.7, "ner"),
        (5, "people", "Jane Smith", "c.txt", None, 0.0, "ner"),
        (6, "documents", "only one", "d.txt", "", None, "file"),
        (7, None, "untyped", "d.txt", "text", 0.5, "file"),
    ]
    df = spark.createDataFrame(rows, "id long, entity_type string, name string, source string, context string, confidence double, extraction_method string")
    embed = features.fit_text_vectors(df.select(F.concat_ws(" ", "name", "context").alias("text")))
    got = {(r.entity_type, r.cluster): r for r in resolve.resolve_entities(df, embed).collect()}
    assert sorted(got, key=str) == sorted([("companies", 1), ("companies", 3), ("people", 4), ("people", 5), ("documents", 6), (None, 7)], key=str)
    summit = got["companies", 1]
    assert (summit.name, summit.sources, summit.cluster_size, summit.confidence) == ("Summit Digital Inc", "a.txt; b.txt", 2, 0.85)
    assert resolve.resolve_entities(df.limit(0), embed).count() == 0
    by_source = resolve.resolve_entities(df, embed, blocks=("source",))
    assert by_source.where("entity_type = 'companies'").count() == 3  # blocked apart


def test_replaced_text_is_not_replaced_again(spark):
    c = spark.createDataFrame([("s", "The Company pays the client, COMPANY co. (Company)"), ("t", "The Company"), ("s", None), ("s", "")], "source string, text string")
    d = spark.createDataFrame([("s", "Company", "Harbor Client Holdings", "entity"), ("s", "company", "Zeta", "entity"), ("s", "Client", "Granite Ltd", "entity"), ("s", "c.o", "dot", "entity"), ("s", "pays", None, "other")], "source string, keyword string, canonical_name string, keyword_type string")
    got = [(r.text, r.replaced) for r in legal.replace_keywords(c, d).collect()]
    assert sorted(got, key=str) == sorted([("The Harbor Client Holdings pays the Granite Ltd, Harbor Client Holdings co. (Harbor Client Holdings)", True), ("The Company", None if False else False), (None, None), ("", False)], key=str)


def test_replacement_is_linear(spark):
    d = spark.createDataFrame([("s", f"term{i}", f"name{i} term{i + 1}", "entity") for i in range(20)], "source string, keyword string, canonical_name string, keyword_type string")
    took = []
    for n in (50_000, 100_000, 200_000):
        c = spark.createDataFrame([("s", "term3 and term19 stand; " * (n // 24))], "source string, text string")
        legal.replace_keywords(c, d).select(F.length("text")).collect()
        began = time.time()
        legal.replace_keywords(c, d).select(F.length("text")).collect()
        took.append(time.time() - began)
    assert took[2] < 6 * took[0] + 3


def test_citations_with_names_inside_names(spark):
    r = spark.createDataFrame([("r", "See {a_b.txt}, {b.pdf} and {a}{x}."), ("q", "none {a}"), ("e", None)], "report string, text string")
    n = spark.createDataFrame([("r", "a_b.txt"), ("r", "b.pdf"), ("r", "a"), ("r", None), ("r", "a"), ("e", "a")], "report string, name string")
    got = {x.report: x.text for x in reports.inline_citations(r, n).collect()}
    assert got == {"r": "See according to **A B**, according to **B** and according to **A**{x}.", "q": "none {a}", "e": None}


def brute_paths(edges, start, goal, most):
    out, todo = set(), [[start]]
    while todo:
        p = todo.pop()
        if len(p) > 1 and p[-1] == goal:
            out.add(" > ".join(p))
        elif len(p) <= most:
            todo += [[*p, b] for a, b in edges if a == p[-1] and b not in p]
    return out


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_meeting_paths_against_brute_force(spark, most):
    rng = np.random.default_rng(most)
    edges = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 9, (26, 2))} | {("n0", f"n{i}") for i in range(9)}
    df = spark.createDataFrame([*edges, ("n1", None), ("n0", "n1")], "src string, dst string")
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 9, (8, 2)) if a != b]
    got = graph.meeting_paths(df, spark.createDataFrame(pairs, "start string, goal string"), most).select("start", "goal", F.array_join("nodes", " > ").alias("path"))
    assert rows_of(got) == sorted((a, b, p) for a, b in set(pairs) for p in brute_paths(edges, a, b, most))


def test_paths_do_not_open_a_hub_towards_dead_ends(spark, monkeypatch):
    edges = [("a", "hub"), ("hub", "m"), ("m", "z"), *[("hub", f"dead{i}") for i in range(500)]]
    kept, stored = {}, graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: kept.setdefault((name, len(kept)), stored(df, name)))
    df, pairs = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a", "z")], "start string, goal string")
    assert [(r.length, r.path) for r in graph.find_paths(df, pairs).collect()] == [(3, "a > hub > m > z")]
    assert sum(t.count() for (name, _), t in kept.items() if name in ("ahead", "behind")) == 2


def test_named_paths_have_limits(spark):
    edges = [("a", f"m{i}") for i in range(8)] + [(f"m{i}", "z") for i in range(8)] + [("a2", f"m{i}") for i in range(8)]
    nodes = [("a", "Acme One"), ("a2", "Acme Two"), ("z", "Zeta"), *[(f"m{i}", f"Mid {i}") for i in range(8)]]
    names = spark.createDataFrame([("ACME", "zeta"), ("acme one", "ZETA"), ("nobody", "zeta"), (None, "zeta"), ("", "zeta"), ("zeta", "zeta")], "start_name string, goal_name string")
    got = graph.named_paths(spark.createDataFrame(nodes, "id string, name string"), spark.createDataFrame(edges, "src string, dst string"), names, total=7).collect()
    by = Counter(r.start_name for r in got)
    assert by == {"ACME": 7, "acme one": 5} and all(r.length == 2 for r in got)
    assert [r.path for r in sorted(got, key=lambda r: r["rank"]) if r.start_name == "acme one"] == [f"a > m{i} > z" for i in range(5)]


def test_chunks_by_table_function(spark):
    rows = [(1, "One. Two. " * 300, "x"), (2, "", "y"), (3, None, "z"), (4, "short", None), (5, "w" * 2500, "q")]
    df = spark.createDataFrame(rows, "id long, text string, pos0 string")
    want = sorted((i, p, c, o) for i, t, o in rows for p, c in enumerate(text.split_recursive(t or "")))
    assert sorted((r.id, r.pos, r.chunk, r.pos0) for r in text.chunks_of(df).collect()) == want
    assert rows_of(text.chunk_recursive(df, "id").select("id", "pos", "chunk")) == [w[:3] for w in want]


def test_figures_of_a_write(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, "abc"), (1, 1, ""), (2, 0, None)], "doc_id long, pos int, chunk string")
    got = text.written_with_stats(c, str(tmp_path / "c"))
    assert (got["chunks"], got["first_chunks"], got["n_chars"], got["empty"]) == (3, 2, 3, 2) and got["chunks_per_second"] > 0
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    none = text.written_with_stats(c.limit(0), str(tmp_path / "d"))
    assert (none["chunks"], none["n_chars"]) == (0, 0)


def test_nested_json_in_and_out(spark, tmp_path):
    flat = [("f", "A", "Corporate", 1, "First item", "1. First item"), ("f", "A", "Corporate", 2, "Second", "Second"), ("f", "B", "Fin \"ance\"", 1, "Third é", "3"), ("g h", "A", "Other", 1, "x\ny", "x")]
    df = spark.createDataFrame(flat, "file string, letter string, category string, item_no int, text string, original string")
    files.write_texts(files.nested_checklists(df).withColumnRenamed("json", "text"), str(tmp_path / "n"))
    back = files.read_texts(spark, str(tmp_path / "n"))
    assert rows_of(files.flat_checklists(back.withColumnRenamed("text", "json"))) == sorted(flat)
    given = '{"A": {"name": "Legal", "items": [{"text": "t1", "original": "o1"}, {"text": "t2"}]}, "B": {"name": "Empty", "items": []}}'
    got = files.flat_checklists(spark.createDataFrame([("x", given), ("y", "no json"), ("z", None)], "file string, json string"))
    assert rows_of(got) == [("x", "A", "Legal", 1, "t1", "o1"), ("x", "A", "Legal", 2, "t2", "t2")]
    asked = '{"q.md": [{"category": "C", "question": "Q?", "id": "A.1"}], "none.md": []}'
    assert rows_of(files.flat_questions(spark.createDataFrame([(asked,)], "json string"))) == [("q.md", "A.1", "C", "Q?")]


def test_text_files_by_name(spark, tmp_path):
    rows = [("a b.md", "# A\n\nline"), ("c.md", ""), ("d.md", None), ("e.md", "two"), ("e.md", "one"), ("123", "ends\n")]
    files.write_texts(spark.createDataFrame(rows, "file string, text string"), str(tmp_path / "t"))
    assert rows_of(files.read_texts(spark, str(tmp_path / "t"))) == [("123", "ends\n"), ("a b.md", "# A\n\nline"), ("c.md", ""), ("d.md", ""), ("e.md", "one\ntwo")]
    assert len([p for p in (tmp_path / "t").glob("file=*/part-*")]) == 5


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("## A. One\n1. Provide the documents\n")
    (tmp_path / "b.txt").write_text("no")
    assert rows_of(files.read_markdown(spark, str(tmp_path))) == [("a.md", "## A. One\n1. Provide the documents\n")]


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("worth $5M today", [("$5M", 5e6)]),
        ("paid $10K, then $1,200.50.", [("$10K", 1e4), ("$1,200.50", 1200.5)]),
        ("about 3 million dollars", [("3 million dollars", 3e6)]),
        ("5M USD and 7 EUR", [("5M USD", 5e6), ("7 EUR", 7.0)]),
        ("$2 billion", [("$2 billion", 2e9)]),
        ("$7 Market", [("$7", 7.0)]),
        ("5 apples, 12 million stars", []),
    ],
)
def test_money_forms(spark, said, found):
    c = spark.createDataFrame([("s", 0, said)], "source string, pos int, text string")
    assert sorted((r.name, r.amount) for r in entities.extract_financials(c).collect()) == sorted(found)


def test_keyed_results(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "s string, n int")
    assert rows_of(checklist.keyed_results(df, ["s", "n"])) == [("a", 1, "result_0"), ("a", 2, "result_1"), ("b", 1, "result_2")]


def test_search_without_an_index(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vec array<float>")
    rescore = lambda df: df.withColumn("score", F.col("similarity"))
    none = vectors.search_documents(None, q, rescore)
    assert none.count() == 0 and none.columns == ["query_id", "vec_id", "similarity", "score", "rank"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.search_documents(v, q, rescore).collect()] == [1]
    assert [(r.vec_id, r.score) for r in vectors.search_documents(v, q, rescore, score_mode="distance").collect()] == [(2, 2.0)]


def test_search_of_one_type(spark):
    nodes = spark.createDataFrame([("c:Acme", "Acme", "c"), ("p:Acme Ann", "Acme Ann", "p"), ("x:acme", "acme", None)], "id string, name string, type string")
    q = spark.createDataFrame([("acme",)], "query string")
    assert [r.id for r in graph.search_entities(nodes, q, types=["p"]).collect()] == ["p:Acme Ann"]
    assert graph.search_entities(nodes, q).count() == 3 and graph.search_entities(nodes, q, types=[]).count() == 0


def test_citation_ids(spark):
    import xxhash

    paths = ["/rooms/a.txt", "", "é", "x" * 100]
    got = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", reports.citation_id(F.col("p"))).collect()}
    for p in paths:
        h = xxhash.xxh64(p.encode(), seed=42).intdigest()
        assert got[p] == (h - (1 << 64) if h >> 63 else h) % 10_000


@pytest.mark.parametrize("block", [2048, 7])
def test_many_queries_meet_all_vectors(spark, monkeypatch, block):
    """Blocks of queries against groups of vectors give what one block gives."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "GROUP", 40)
    rng = np.random.default_rng(11)
    x, q = rng.normal(size=(150, 5)).round(2), rng.normal(size=(30, 5)).round(2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    a = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(q)] + [("none", None)], "query_id string, query_vec array<double>")
    d = np.round(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 6)
    want = {(f"q{i}", int(k), r) for i in range(30) for r, k in enumerate(sorted(range(150), key=lambda k: (d[i, k], k))[:4], 1)}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in vectors.knn_l2(v, a, 4).collect()} == want
    c = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    found = vectors.cosine_matrix(v, a, least=0.5).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(f"q{i}", int(k)) for i, k in zip(*np.nonzero(np.round(c, 6) >= 0.5), strict=True)}


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (1, 400), (50, 400), (0, 300)])
def test_pruned_bm25_against_every_posting(spark, monkeypatch, seed, n):
    """Terms are left out, yet hits and scores are those of a plain loop."""
    monkeypatch.setattr(sparse, "SEED", seed)
    rng = np.random.default_rng(n + seed)
    vocab = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61) ** 1.1
    p /= p.sum()
    docs = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 60)), p=p))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "w3 w3 w3")]
    queries = [(q, " ".join(rng.choice(vocab, 12, p=p))) for q in range(12)] + [(90, "unknown words"), (91, None), (92, "w1 w1 w59")]
    toks = {i: words(t) for i, t in docs}
    known = [t for i, t in docs if t is not None]
    avgdl = sum(len(words(t)) for t in known) / len(known)
    df = Counter(w for ws in toks.values() for w in set(ws))
    raw = {w: math.log(len(docs) - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if r < 0 else r for w, r in raw.items()}
    want = set()
    for q, t in queries:
        scores = {}
        for i, ws in toks.items():
            tf = Counter(ws)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in words(t) if w in tf)
            if round(s, 6) > 0:
                scores[i] = round(s, 6)
        want |= {(q, i, r) for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5], 1)}
    d, a = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "q long, text string")
    assert {(r.q, r.id, r["rank"]) for r in sparse.bm25_search(d, a, "id", "q", top_k=5).collect()} == want
