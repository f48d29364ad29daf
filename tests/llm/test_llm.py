"""The numbered operators against brute force, round trips and held-out labels, with nulls, ties and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import hypothesis
import hypothesis.strategies
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import chunks, decontam, html_text, licenses, mixing, ngram_join, quality, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls, empty, very long, repeated and near-equal texts."""
    base = words(200, 1)
    near = [*base[:100], "changed", *base[101:]]
    passage = " ".join(words(60, 2))
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", "  \n ", "one two", " ".join(words(20_000, 3, 5000)), "a " * 300]
    texts += [" ".join(words(80, s)) + f" {passage} " + " ".join(words(80, s + 50)) for s in (11, 12, 13)]
    texts += ["Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0", "line\nline\nline other\n\n"]
    out = [(i, t, "en", ("s1", "s2", None)[i % 3], 0) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "a null id here", "en", "s1", 0), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_warc_round_trip_and_magic_in_payloads(spark):
    fake = "x WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nv", fake * 3), (6, "é", "é" * 10), (None, "n", "same"), (7, "w", "x" * 100_000)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None}
    for i, _, h in pages:
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, None)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("revisit", 2)]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_headers_of_any_length(spark):
    pages = [(1, "u1", "one"), (2, "data:text/plain," + "x" * 100_000, "two"), (3, "u3/WARC/1.0", "three"), (4, "u4", "WARC/1.0\r\n" * 1000)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert {r.page_id: r.payload_bytes for r in got} == {1: 3, 2: 3, 3: 5, 4: 10_000}


def test_hostile_payloads_are_no_records(spark):
    head = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n"
    many = "".join(head.format(i, 100_000) for i in range(3000)) + "x" * 100_000
    pages = [(1, "u1", head.format("9" * 20, 0)), (2, "u2", head.format(7, "1" * 5000)), (3, "u" * 1_000_000, many), (4, "u4", "y" * (warc.LARGE + 1)), (5, "u5", head.format(8, "9" * 19) + head.format(9, 1))]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert {r.page_id: (r.payload_bytes, r.record_type) for r in got} == {i: (len(h), "response") for i, _, h in pages} and len(got) == 5


def test_broken_warc_chain_raises(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    part = next((tmp_path / "w").rglob("part-*"))
    data = part.read_bytes()
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 5
    for cut in (data[:-20], data.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1", 1), data + b"x"):
        (tmp_path / str(len(cut))).mkdir(exist_ok=True)
        (tmp_path / str(len(cut)) / "part-0").write_bytes(cut)
        with pytest.raises(ValueError, match="do not lead"):
            warc.read_archives(spark, str(tmp_path / str(len(cut))))


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]


def test_ngram_join(spark, docs, rows, none):
    got = ngram_join.jaccard_classes(docs).collect()
    links = brute_links([r[1] for r in rows])
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r[0], len(x)) for r, x in zip(rows, links, strict=True))
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[0] == classes[1] == classes[2] == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and 1 not in ids and 2 not in ids and ids[3] == 1 and ids[9] == 1
    assert ngram_join.jaccard_classes(none).count() == 0


def test_recall_on_a_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    links = brute_links([r.text for r in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(docs).collect()}
    pairs = [(rows[i].doc_id, rows[j].doc_id) for i, x in enumerate(links) for j in x]
    assert pairs and sum(got[i][0] == got[j][0] for i, j in pairs) >= 0.9 * len(pairs)
    assert sum(got[r.doc_id][1] == len(x) for r, x in zip(rows, links, strict=True)) >= 0.99 * len(rows)


def test_ngram_join_of_a_large_group(spark):
    """Over one block of near copies that are all different texts."""
    base = words(150, 5)
    texts = [" ".join([*base[: i % 150], f"e{i}", *base[i % 150 + 1 :]]) for i in range(300)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = brute_links(texts)
    assert all(got[i] == (0, len(links[i])) for i in range(300))


def test_near_copies_in_buckets_of_unlike_documents(spark):
    """A hot passage puts unlike documents into one bucket, also as its ends: near copies between them still meet."""
    from foliant.functions.components import connected_components

    r = np.random.default_rng(3)
    texts = r.integers(0, 256, (120, 231), np.uint8)
    sketches = np.concatenate([texts, texts[10:60]])
    copies = sketches[120:]
    copies[:, :46] += r.integers(1, 256, (50, 46)).astype(np.uint8)  # they agree in 0.8 of the places
    keys = [bytes([i // 256, i % 256]) for i in range(len(sketches))]
    sizes = [100 + 40 * (i % 2) for i in range(120)] + [int(1.25 * (100 + 40 * (i % 2))) for i in range(10, 60)]
    nodes = spark.createDataFrame([(k, s, [5], x.tobytes()) for k, s, x in zip(keys, sizes, sketches, strict=True)], "key binary, size long, bands array<long>, sketch binary")
    for cell in (ngram_join.CELL, 16):
        ngram_join.CELL, kept = cell, ngram_join.CELL
        found = {bytes(x.id): bytes(x.component) for x in connected_components(ngram_join.candidate_edges(nodes)).collect()}
        ngram_join.CELL = kept
        assert found == {k: keys[i] for i in range(10, 60) for k in (keys[i], keys[110 + i])}


def test_bands_reach_the_recall():
    b, r = ngram_join.bands_and_rows(0.8)
    assert 1 - (1 - 0.8**r) ** b >= ngram_join.RECALL


def test_toxicity_holds_out_a_third(spark):
    r = random.Random(0)
    bad = ["idiot", "scum", "moron"]
    data = [(i, " ".join([*words(60, i), *(r.sample(bad, 2) if i % 5 == 0 else [])])) for i in range(600)]
    docs = spark.createDataFrame([*data, (None, "x"), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in data] + [(None, 1), (0, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items() if i is not None)
    held = [(x.predicted, int(i % 5 == 0)) for i, x in got.items() if i is not None and i < 600 and x.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert not any(p and not y for p, y in held)
    clean = toxicity.clean_documents(docs.withColumn("score", F.lit("own")), labels)
    assert clean.columns == ["doc_id", "text", "score"] and 450 < clean.count() < 520
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0
    assert {x.predicted for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_factorization_machine_learns_pairs():
    """Each term alone is harmless, both together are toxic."""
    r = np.random.default_rng(0)
    x = [np.array(sorted(({1} if i % 2 else set()) | ({2} if i // 2 % 2 else set()) | {10 + int(r.integers(5))})) for i in range(400)]
    y = np.array([float(1 in s and 2 in s) for s in x], np.float32)
    m = toxicity.Model(toxicity.fit(x, y))
    assert m.score(np.array([1, 2])) > 0.7 > m.score(np.array([1])) and m.score(np.array([2])) < 0.7
    for s in x[:50]:  # the score is the sum over all pairs
        known = [int(np.flatnonzero(m.ids == t)[0]) for t in s if t in m.ids]
        f = m.bias + sum(m.w[i] for i in known) + sum(float(m.v[i] @ m.v[j]) for i in known for j in known if i < j)
        assert m.score(s) == pytest.approx(1 / (1 + np.exp(-f)))


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    few, many, text = toxicity.Terms(), toxicity.Terms(), " ".join(f"word{i}x{i}" for i in range(500))
    assert (toxicity.text_terms(text, few) == toxicity.text_terms(text, many)).all() and len(few) + len(few.starts) < 60


def test_html_main_text_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = html_text.main_text(pages).collect()
    assert len(got) == len(html)
    for r in got:
        inside = re.search(r"(?s)<article>(.*?)</article>", html[r.page_id])[1]
        import html as entities

        want = " ".join(entities.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inside).replace("<b>", "")).split())
        assert r.text == want and r.n_chars == len(want)
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article>&lt;b&gt; caf&eacute;" + " word" * 30_000)], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_text.main_text(odd).collect()}
    assert texts[1] == texts[2] == "" and len(texts[3].split()) == 30_002


def test_blocks_of_odd_pages():
    texts = lambda h: [b.text for b in html_text.blocks(h)]
    assert texts("<head><meta charset=x><title>no</title><article><p>Hello") == ["Hello"]
    assert texts("<head>no<title>no</title></head><body><p>a<br>b") == ["a", "b"] and texts("<p>" * 3) == texts("") == []
    page = html_text.blocks("<p>" + "a " * 150 + "b " * 5000)
    assert len(html_text.inputs(page)[1][0]) == 5150


def test_pages_of_any_length_are_labelled_alike():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    pages = [html_text.blocks(html_text.written_page(r, vocabulary)) for _ in range(30)]
    model = html_text.fit(pages, epochs=2)
    longest = html_text.blocks("".join(f"<p>{i} words here</p>" for i in range(3000)))
    together = html_text.label(model, [*pages, longest, []])
    assert all((html_text.label(model, [p])[0] == y).all() for p, y in zip(pages, together, strict=False)) and len(together[-2]) == 3000


def test_html_text_of_no_pages(spark):
    wide = spark.createDataFrame([(1, "u", "<article><p>one two three four five six</p></article>", "own", 3)], "page_id long, url string, html string, text string, n_chars long")
    assert html_text.main_text(wide.limit(0)).count() == 0 and html_text.main_text(wide).columns == ["page_id", "url", "text", "n_chars"]


def test_html_labeller_on_unseen_layouts():
    r = np.random.default_rng(99)
    vocabulary = [f"w{i}" for i in range(2000)]
    model = html_text.fit([html_text.blocks(html_text.written_page(r, vocabulary)) for _ in range(250)], epochs=10)
    test = [p for p in (html_text.blocks(html_text.written_page(r, vocabulary)) for _ in range(80)) if p]
    right = np.concatenate([np.array([b.marked for b in p]) == y for p, y in zip(test, html_text.label(model, test), strict=True)])
    assert right.mean() > 0.96


def test_html_tokens_are_linear_and_keep_text():
    texts = [b.text for b in html_text.blocks("<p>a <b>b</b>c<script>var x='</p>';</script> d<br>e &amp; f < g<!-- <p>no --><style>p{}</style></p><div class=\"x>y\">h")]
    assert texts == ["a bc d", "e & f < g", "h"]
    html_text.blocks("<a '" * 20_000)


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(text):
    return LICENSE_WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_licenses(docs, rows, none):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = lower_words(t)
        starts = [(k, name) for p, name in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min((k for k, _ in starts), default=None), max((k for k, _ in starts), default=None))
        assert r.base_labels == ",".join(sorted({n for _, n in starts}))
    assert by[12].labels == "apache-2,cc-by-nc,cc-by-nc-4.0,mit" and by[12].score == 0.95
    assert licenses.scan_licenses(none).count() == 0


def test_license_overlaps(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "under the mit license under the mit license", "no license here", "the mit university", "GNU Lesser General Public License v2.1 or later", "cc by nc cc by nc"]
    got = [r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r.labels for r in got] == ["gpl-3", "mit", "", "", "lgpl-2.1", "cc-by-nc"]
    assert got[1].n_base == 2 and got[1].last_word == 4 and got[5].n_base == 2
    assert len(got[0].detections) == 1 and (got[0].detections[0].start, got[0].detections[0].end) == (2, 12)
    assert len(licenses.rules()) > 300


def test_license_gate_lets_every_rule_through(spark, monkeypatch):
    """Texts for every rule, and the same with other characters between words, give what they give without the gate."""
    fill = lambda p: re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", p))
    texts = []
    for *_, pattern, _, _ in licenses.rules():
        t = pattern.removeprefix("(?<= )").removesuffix("(?= )")
        while (shorter := fill(t)) != t:
            t = shorter
        t = re.sub(r".\?", "", t.replace("[sc]", "c")).split("|")[0]
        texts += [t, f"({t.upper()})", "Text. " + t.replace(" ", "\n-") + ", as is"]
    texts += ["Released under the Apache 2.0", "distributed under MPL 2.0", "available under the MIT", "WTFPL", "CC0 1.0", "ODbL", "EPL 2.0", "public-domain", "public\ndomain", "Creative\nCommons Attribution 4.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = lambda: {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    gated = found()
    assert all(gated[len(texts) - k][0] for k in range(1, 11))
    monkeypatch.setattr(licenses, "gate", lambda text: F.lit(True))
    assert gated == found() and sum(bool(x) for x, _ in gated.values()) > 0.8 * len(texts)


def test_quality(docs, rows, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 2 * len(covered) > len(w))] += 1
    assert got == want
    assert quality.quality_rules(none).count() == 0


def test_bad_hosts_fail_as_a_whole(spark):
    good = [(i, " ".join(words(100, i)), f"h{i % 10}") for i in range(200)]
    bad = [(1000 + i, " ".join(words(100, i)) if i % 4 == 0 else "short text", "bad") for i in range(100)]
    got = quality.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r.source_size == sizes[r.source] and r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6 for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(sizes.values())) < 1e-3
    taken, most = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[r.source] - r.target) <= most[r.source] for r in got)
    again = Counter(tuple(r) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter(tuple(r) for r in got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got if r.size)  # texts without words are never taken
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    level = {"a": 20.0, None: 200.0}  # weights 5, 2, 1, 5
    rest = 1.5 * 1610 - 220
    assert got == pytest.approx(level | {"b": rest * 2 / 3, "c": rest / 3})


def brute_decontamination(rows, items, n=13):
    wins = {}
    for i, t in items:
        w = lower_words(t)
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = Counter()
    for i, t in rows:
        w, hit, found = lower_words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in wins:
                    hit.update(range(k, k + m))
                    found |= wins[g]
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    """Blocks are bounded in bytes, a row stands in one of them, and results do not depend on them."""
    items = [(1, rows[0][1]), (2, " ".join(words(60, 2)[10:30])), (3, "one two"), (4, rows[7][1][:4000]), (5, None), (6, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 50_000)
    anchors = decontam.item_anchors(docs, benchmark)
    parts = [b.collect() for b in decontam._blocks(anchors)]
    assert len(parts) > 3 and max(map(len, parts)) < anchors.count() / 2 and sorted(sum(parts, [])) == sorted(anchors.collect())
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, benchmark).collect())
    assert got == brute_decontamination([(r[0], r[1]) for r in rows], items)


def test_decontamination(spark, docs, rows, none):
    items = [(1, rows[0][1][:300]), (2, "Two, Words"), (10, None), (11, "..."), (3, " ".join(words(60, 2))), (3, "one TWO"), (4, " ".join(words(13, 77)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, benchmark).collect())
    assert got == brute_decontamination([(r[0], r[1]) for r in rows], items)
    clean = decontam.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in got.items() if not k[-1])
    assert decontam.decontaminate(none, benchmark).count() == 0
    assert not decontam.decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").count()


def test_proximity(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x delta y gamma beta alpha z"), (2, "alpha beta gamma delta"), (3, "alpha beta")], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontam.decontaminate(docs, item).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 0)}


def test_proximity_of_long_items(spark):
    """Every window counts, also those whose rarest word stands at an end."""
    r, items, rows = random.Random(4), [], []
    for i in range(12):
        items.append((i, " ".join(words(r.randrange(8, 30), i, 60))))
    for i in range(40):
        part = items[i % 12][1].split(" ")
        at = r.randrange(max(1, len(part) - 13))
        moved = part[at : at + 13]
        r.shuffle(moved)
        moved = [x for w in moved for x in (w, *(words(1, r.random(), 50) if r.random() < i / 40 else []))]
        rows.append((i, " ".join(words(15, 99 + i, 60) + moved + words(15, 199 + i, 60))))
    texts = [lower_words(t) for _, t in rows]
    df = Counter(w for t in texts for w in t)
    want = {}
    for i, t in enumerate(texts):
        near = set()
        for k, item in items:
            w = lower_words(item)
            for s in range(max(1, len(w) - 12)):
                win = w[s : s + 13]
                rare = min(range(len(win)), key=lambda q: (df[win[q]], q))
                if any(x == win[rare] and set(win) <= set(t[max(0, p - 20) : p + 21]) for p, x in enumerate(t)):
                    near.add(k)
        want[i] = len(near)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x.n_near for x in decontam.decontaminate(docs, benchmark).collect()}
    assert got == want and len(set(want.values())) > 1


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 4095, 4096, 4097, 20_000):
        for top in (1, 7, 16, 32, 63):
            v = r.integers(0, 1 << top, n, dtype=np.uint64)
            v[: n // 9] = 15  # a raw value that looks like an escape
            w, firsts = tokens.pack(v)
            assert (tokens.unpack(w, n) == v).all() and len(firsts) == -(-n // tokens.BLOCK_IDS)
            if n > 5000:
                assert (tokens.unpack(w[firsts[1] : firsts[2]], 4096) == v[4096:8192]).all()


def test_token_output(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = tokens.token_output(docs, TOKENIZER).orderBy("start").collect()
    at, want = 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokens.token_output(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a\n b", "é  ñ x y", "x <|endoftext|> y z<|endoftext|>", "tab\t tab", "it's we'll  'd 12½ x²", "ﬁ 漢字 テスト 🙂 a🙂b", "a" * 5000])
def test_pieces_give_whole_text_ids(text):
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(TOKENIZER), ["Two words.\nMore", text, "end"]
    ids, lengths = tokens.encoder(TOKENIZER).encode(pa.array(texts))
    want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))


@hypothesis.given(hypothesis.strategies.text(alphabet=" \n\t\u00a0ab.,'é漢1<|>", max_size=60))
@hypothesis.settings(max_examples=150, deadline=None)
def test_any_text_gives_whole_text_ids(text):
    e = tokens.encoder(TOKENIZER)
    ids, _ = e.encode(pa.array([text]))
    assert ids[:-1].astype("<u4").tobytes() == e.whole([text])[0]


def test_repeated_passages(spark, docs, rows, none):
    got = {r.doc_id: r for r in chunks.shared_passages(docs).collect()}
    assert len(chunks.shared_passages(docs).collect()) == len(rows)
    for i in (9, 10, 11):
        assert 20 <= got[i].n_shared_words <= 75
        assert (got[i].n_removed_words > 0) == (i > 9)
    assert got[10].first_docs == [9] and got[0].n_shared_words == 200 and got[0].n_removed_words == 0 and got[2].n_removed_words == 200
    assert got[7].n_shared_words == 0 and got[3].n_shared_words == 0
    clean = {r.doc_id: r.text for r in chunks.without_passages(docs).collect()}
    assert clean[2] == "" and clean[9] == rows[9][1] and len(clean[10]) < len(rows[10][1]) and clean[3] is None
    assert chunks.shared_passages(none).count() == 0


def test_chunks_cover_and_resist_insertions():
    text = " ".join(words(2000, 8)).encode() + "ß漢".encode() * 600
    ends = chunks.cuts(text)[0].tolist()
    assert ends[-1] == len(text) and all(b - a <= chunks.MOST for a, b in zip([0, *ends], ends, strict=False))
    parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert all(p.decode() for p in parts)
    moved = b"inserted words here " + text
    e2 = chunks.cuts(moved)[0].tolist()
    other = {moved[a:b] for a, b in zip([0, *e2], e2, strict=False)}
    assert sum(p in other for p in parts) >= len(parts) - 5


@pytest.mark.parametrize("letters", ["漢字仮名交文章試験用長", "abcdefghij0123456789+/"])
def test_chunks_of_text_without_blanks_resist_insertions(letters):
    r = random.Random(2)
    text = "".join(r.choice(letters) for _ in range(6000))
    parts = []
    for t in (text, letters[:2] + text):
        data = t.encode()
        ends = chunks.cuts(data)[0].tolist()
        parts.append([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        assert all(p.decode() and len(p) <= chunks.MOST for p in parts[-1])
    assert len(parts[0]) > 20 and sum(p in set(parts[1]) for p in parts[0]) >= 0.9 * len(parts[0])


def test_passages_without_blanks_are_found(spark):
    r = random.Random(3)
    new = lambda n: "".join(r.choice("漢字仮名交文章試験用長") for _ in range(n))
    passage = new(600)
    docs = spark.createDataFrame([(1, new(400) + passage + new(300)), (2, new(333) + passage), (3, new(900))], "doc_id long, text string")
    got = {x.doc_id: x for x in chunks.shared_passages(docs).collect()}
    assert got[1].n_shared_words > 100 and got[2].n_removed_words > 100 and got[3].n_shared_words == 0
    assert len({x.doc_id: x.text for x in chunks.without_passages(docs).collect()}[2]) < 600


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def brute_passages(rows):
    """(doc_id, shared bytes, removed bytes) by row: every run of chunks with enough words is looked for in all texts."""
    texts = {}
    for i, t in rows:
        data = (t or "").encode()
        ends, keyed = (x.tolist() for x in chunks.cuts(data)) if data else ([], [])
        total = np.append(0, np.cumsum(chunks.word_starts(data))) if data else [0]
        found = []
        for k, a in enumerate([0, *ends[:-1]] if ends else []):
            b = next((e for e in ends[k:] if total[e] - total[a] >= chunks.MIN_WORDS), None)
            if b and keyed[k]:
                found.append((a, b))
            if b and total[-1] - total[ends[k]] < chunks.MIN_WORDS:
                found.append((a, len(data)))
        texts[(i, t)] = (data, found)
    whole = {}
    for (i, _), (data, found) in texts.items():
        for a, b in found:
            whole.setdefault(data[a:b], set()).add(i)

    def covered(data, found, keep):
        at = set()
        for a, b in found:
            if keep(whole[data[a:b]]):
                at |= set(range(a, b))
        return len(at)

    spans = {(i, t): (covered(d, f, lambda docs: len(docs) > 1), covered(d, f, lambda docs, i=i: min(docs) < i)) for (i, t), (d, f) in texts.items()}
    return Counter((i, *spans[(i, t)]) for i, t in rows)


def span_bytes(spans):
    return sum(x.end - x.start for x in spans or [])


def test_passages_against_brute_force(spark, docs, rows, sf):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for data, table in ((rows_of(docs), docs), (given, spark.read.parquet(f"{sf}/documents.parquet"))):
        assert Counter((r.doc_id, span_bytes(r.shared), span_bytes(r.removed)) for r in chunks.shared_passages(table).collect()) == brute_passages(data)


def test_words_of_spans(spark, sf):
    """Removed words are counted right, and every removed span's words stand in an earlier document in runs of MIN_WORDS."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in table.collect()}
    seen = 0
    for r in chunks.shared_passages(table).collect():
        data = (text[r.doc_id] or "").encode()
        total = np.append(0, np.cumsum(chunks.word_starts(data))) if data else None
        for x in r.removed or []:
            seen += 1
            assert x.words == total[x.end] - total[x.start] >= chunks.MIN_WORDS
            earlier = "\n".join(t for i, t in text.items() if i < r.doc_id and t)
            ws = data[x.start : x.end].decode().split(" ")
            assert " ".join(ws[: chunks.MIN_WORDS // 2]) in earlier
    assert seen


def test_chunks_of_many_documents_make_no_passage(spark):
    """One short run of chunks from each of eleven documents is no passage; nor is one repeated word that stands elsewhere fewer times."""
    others = [" ".join(words(60, 400 + s, 5000)) for s in range(11)]
    parts = []
    for t in others:
        ends = chunks.cuts(t.encode())[0].tolist()
        inner = [(a, b) for a, b in zip(ends, ends[1:], strict=False) if 3 <= len(t.encode()[a:b].split()) <= 14]
        parts.append(t.encode()[inner[0][0] : inner[0][1]].decode())
    stitched = "".join(parts)
    rows = [*enumerate(others), (50, stitched), (60, "ist " * 12 + "und so weiter"), (61, "ist " * 15), (62, "wort " + "ist " * 90), (63, "the licence of this file is free and it may be copied " + others[0][:40])]
    got = {r.doc_id: r for r in chunks.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(stitched.split()) > 30
    assert all(got[i].n_shared_words == 0 for i, _ in rows)


def shared_words(data, other):
    """The most words of a run of chunks that both texts have."""
    found = []
    for d in (data, other):
        ends, keyed = (x.tolist() for x in chunks.cuts(d))
        total = np.append(0, np.cumsum(chunks.word_starts(d)))
        runs = [(a, next((e for e in ends[k:] if total[e] - total[a] >= chunks.MIN_WORDS), None)) for k, a in enumerate([0, *ends[:-1]]) if keyed[k]]
        found.append({d[a:b] for a, b in runs if b})
    return max((len(x.split()) for x in found[0] & found[1]), default=0)


@hypothesis.given(
    hypothesis.strategies.lists(hypothesis.strategies.text(alphabet="aé漢zq.", min_size=1, max_size=30), min_size=51, max_size=51),
    hypothesis.strategies.lists(hypothesis.strategies.text(alphabet="abc漢 \n", max_size=40), min_size=4, max_size=4),
)
@hypothesis.settings(max_examples=300, deadline=None)
def test_every_passage_of_51_words_is_found(passage, around):
    """Whatever the words of a shared passage and what stands beside it."""
    one, two = ((f"{a} " + " ".join(passage) + f"\n{b}").encode() for a, b in (around[:2], around[2:]))
    assert shared_words(one, two) >= chunks.MIN_WORDS


@pytest.mark.parametrize("vocabulary", [1, 5, 300, 5000])
def test_recall_of_51_word_passages(vocabulary):
    """All of 300 passages, of one-letter words too, are found in unlike surroundings."""
    for s in range(300):
        passage = " ".join(words(51, s, vocabulary)) if vocabulary > 5 else " ".join(random.Random(s).choices("abcde"[:vocabulary], k=51))
        one, two = ((" ".join(words(40, 1000 * k + s, 5000)) + " " + passage + " " + " ".join(words(40, 3000 * k + s, 5000))).encode() for k in (1, 2))
        assert shared_words(one, two) >= chunks.MIN_WORDS


def test_clashing_column_names(spark, docs):
    """Filters carry every column of the documents, whatever its name."""
    own = {"k": 1, "c": 2, "d": 3, "key": 4, "score": 5, "class_id": 6, "removed": 7, "n_words": 8, "contaminated": 9, "copies": 10, "tkey": 11, "size": 12, "first": 13, "c0": 14, "__t": 15, "__k": 16, "__r": 17, "__d": 18, "__key": 19, "doc": 20, "id": 21, "kept_id": 22, "row": 23, "n": 24, "r": 25, "wordless": 26}
    wide = docs.withColumns({n: F.lit(v) for n, v in own.items()})
    benchmark = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (ngram_join.one_of_each(wide), decontam.clean_documents(wide, benchmark), mixing.mixed_documents(wide), chunks.without_passages(wide), toxicity.clean_documents(wide, labels)):
        assert out.columns == wide.columns
        assert {tuple(r[n] for n in own) for r in out.collect()} == {tuple(own.values())}
    for f in (ngram_join.jaccard_classes, licenses.scan_licenses, quality.quality_rules, mixing.mix, chunks.shared_passages):
        assert f(wide).count() == docs.count()
