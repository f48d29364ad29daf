"""Hard negatives, spelling variants and language identification against brute force, with odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import languages, negatives, spelling

VECTORS = "vec_id long, label int, embedding array<double>, row string, q int, id string"


def brute_negatives(rows, is_anchor, positives=5, negatives_=3):
    kept = []
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((i, label, [math.floor(256 * x) for x in vec]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for at, (i, label, vec) in enumerate(kept):
        if not is_anchor(i):
            continue
        others = [(j, other, score(vec, v)) for k, (j, other, v) in enumerate(kept) if k != at]
        like = sorted((-s, j) for j, other, s in others if other == label)[:positives]
        for p, j in like:
            near = sorted((-s, k) for k, other, s in others if other != label and 50 * -p <= 100 * s <= 95 * -p)[:negatives_]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(near, 1)]
    return sorted(out)


def mined_rows(spark, rows, is_anchor):
    df = spark.createDataFrame([(i, label, v, "x", 1, "y") for i, label, v in rows], VECTORS)
    prepared = negatives.prepared(df)
    return sorted(tuple(r) for r in negatives.hard_negatives(prepared, is_anchor).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(size=70)]) for i in range(90)]
    rows += [(100, 1, [1.0] * 70), (101, 1, [1.0] * 70), (102, 2, [0.8] * 70), (103, 2, [0.8] * 70), (104, 0, [0.8] * 70)]  # ties
    rows += [(105, None, [1.0]), (None, 1, [1.0]), (106, 1, None), (107, 1, [1.0, None]), (108, 1, [float("nan")]), (109, 1, [float("inf")])]
    rows += [(110, 1, []), (111, 2, [0.5]), (112, 1, [-1.0] * 70), (rows[0][0], rows[0][1], rows[0][2]), (112, 1, [-1.0] * 70)]  # short, opposite, repeated
    got = mined_rows(spark, rows, F.col("id") % 10 == 0)
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert got


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=64) * 2e4 + 5e4]) for i in range(12)]
    assert mined_rows(spark, rows, F.lit(True)) == brute_negatives(rows, lambda _: True)
    with pytest.raises(ValueError, match="scale"):
        mined_rows(spark, [(1, 1, [1e30]), (2, 2, [1.0])], F.lit(True))


def test_scores_by_residues():
    rng = np.random.default_rng(3)
    for most, width in ((3, 1), (200, 64), (30_000, 130), (10_000_000, 200)):
        a, b = rng.integers(-most, most + 1, (5, width)), rng.integers(-most, most + 1, (7, width))
        a[0], b[0] = most, -most
        primes = negatives.moduli(width * most * most)
        assert (negatives.exact_scores(a, b, primes) == a @ b.T).all()
        assert len(primes) >= math.ceil(math.log(4 * width * most * most, 1024))


def test_no_vectors(spark):
    assert mined_rows(spark, [], F.lit(True)) == []
    assert mined_rows(spark, [(1, 1, [1.0])], F.lit(True)) == []
    assert mined_rows(spark, [(1, 1, [1.0]), (2, 1, [1.0])], F.col("id") > 5) == []


def brute_spelling(docs):
    counts = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                if len(word) >= 7:
                    counts[word] += 1
            run = ""
    n = {w: c for w, c in counts.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: best for w in n if close[w] for best in [min(close[w], key=lambda v: (-n[v], v))] if n[best] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n)


def grouped(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, n int, word string, run string")
    return sorted(tuple(r) for r in spelling.spelling_groups(df).collect())


def test_spelling_of_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_WORDS", 5)
    monkeypatch.setattr(spelling, "SLICE_WORDS", 20)
    rng = random.Random(4)
    stems = ["agreement", "schöner", "Übermut", "abcdefgh", "stressed", "desserts", "aaaaaaa", "aaaaaaaa", "ÀÉÎõüÿ÷×"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(20):
            w = rng.choice(stems)
            kind = rng.random()
            at = rng.randrange(len(w))
            if kind < 0.1:
                w = w[:at] + w[at + 1 :]
            elif kind < 0.2:
                w = w[:at] + rng.choice("aeiouß") + w[at:]
            elif kind < 0.3:
                w = w[:at] + rng.choice("xyzé") + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice((" ", ", ", "\n", "1", "_")).join(words)))
    docs += [(None, "agreement agreement agreemen agreemen"), (7, None), (8, ""), (9, "short wörds ab"), (10, "long" * 5000 + " " + "long" * 5000), docs[0], docs[0]]
    got, want = grouped(spark, docs), brute_spelling(docs)
    assert got == want
    assert any(f for _, f, *_ in got) and any(f and r != f for _, f, r, *_ in got) or any(f for _, f, *_ in got)


def test_forms_are_followed(spark):
    docs = [(i, " ".join(["agreement"] * 40 + ["agreementx"] * (4 if i < 30 else 0) + ["agreementxy"] * (1 if i < 3 else 0) + ["unlike word"])) for i in range(100)]
    want = brute_spelling(docs)
    assert grouped(spark, docs) == want
    assert {w: r for w, _, r, *_ in want}["agreementxy"] == "agreement"


def test_no_words(spark):
    assert grouped(spark, []) == []
    assert grouped(spark, [(1, None), (2, "a b c"), (3, "agreement")]) == []


DOCS = "doc_id long, text string, lang string, score double, told string"


def tell(spark, rows):
    df = spark.createDataFrame([(i, t, lang, 0.5, "x") for i, t, lang in rows], DOCS)
    return {r.doc_id: r for r in languages.languages(df).collect()}


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    told = languages.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(told) > 200
    assert sum(r.lang == r.lang_pred for r in told) / len(told) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in told)


def test_mixed_documents_have_both_languages(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = languages.learn(docs)
    by = {r.lang: r.text for r in docs.where("lang is not null and length(text) between 2000 and 6000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    a, b = sorted(by)[:2]
    mixed = spark.createDataFrame([(by[a][:1500] + " " + by[b][:500],), (by[a],), ("",), (None,), ("1 2 3 !",), ("é",)], "text string")
    rows = [r.told for r in mixed.select(languages.language_of(F.col("text"), model).alias("told")).collect()]
    assert rows[0].langs[:2] == [a, b] and rows[0].shares[0] > rows[0].shares[1] > 0.1
    assert rows[1].langs == [a] and rows[1].score == 1
    assert [(r.lang_pred, r.score) for r in rows[2:5]] == [("und", 0.0)] * 3
    assert rows[5].lang_pred in model.langs


def test_shares_against_plain_rounds():
    """Batched rounds equal a plain loop over one document, whatever stands beside it."""
    rng = np.random.default_rng(5)
    docs = [np.log(rng.dirichlet(np.ones(3), n) + 1e-9) for n in (1, 40, 7)]
    starts = np.cumsum([0, *[len(d) for d in docs[:-1]]])
    together = languages.shares_of(np.concatenate(docs), starts)
    for d, got in zip(docs, together, strict=True):
        alone = languages.shares_of(d, np.array([0]))[0]
        assert np.allclose(got, alone, atol=1e-12)
        like = np.exp(d - d.max(axis=1, keepdims=True))
        share = [1 / 3] * 3
        for _ in range(languages.ROUNDS):
            total = [0.0] * 3
            for row in like:
                s = sum(x * y for x, y in zip(share, row, strict=True))
                total = [t + x * y / s for t, x, y in zip(total, share, row, strict=True)]
            share = [t / len(like) for t in total]
        assert np.allclose(languages.fitted(like, np.array([0]), np.full((1, 3), 1 / 3), languages.ROUNDS)[0][0], share)


def test_trigrams_of_letters():
    at, first = languages.letters("Ab, c1d\n" + "x" * 30)
    assert len(at) == 2 + 1 + 1 + 30
    assert np.flatnonzero(first).tolist() == [0, 2, 3, 4, 4 + languages.UNIT, 4 + 2 * languages.UNIT]
    assert (at[:2] == languages.letters("...aB")[0]).all()
    assert len(languages.letters("12 !")[0]) == 0 and len(languages.letters("")[0]) == 0


def test_languages_of_odd_tables(spark):
    assert tell(spark, []) == {}
    rows = [(1, "hello there", None), (2, None, "en"), (3, "", "en")]
    assert {i: (r.lang_pred, r.score) for i, r in tell(spark, rows).items()}[1] in [("und", 0.0), ("en", 1.0)]
    learned = [(i, "the house and the garden", "en") for i in range(20)] + [(i, "der garten und das haus", "de") for i in range(20, 40)]
    got = tell(spark, [*learned, (50, "the garden", None), (51, "das haus", "xx"), (None, "und der garten", None), (52, "und " * 100_000, "de")])
    assert got[50].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False and got[52].lang_pred == "de"
