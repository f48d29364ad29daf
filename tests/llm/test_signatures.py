"""Sentences of licenses, overlaps by brute force, and texts that once took quadratic time."""

import re
import time

import pytest
from pyspark.sql import functions as F

from foliant.llm import html_text, licenses

SAID = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
    ("... to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "mit"),
    ("https://opensource.org/licenses/MIT", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd-2-clause"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in", "bsd-2-clause"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause"),
    ("This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties", "bsd"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    ("the GNU General Public License as published by the Free Software Foundation; version 2.", "gpl-2"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3", "agpl-3"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "gpl"),
    ("You should have received a copy of the GNU General Public License along", "gpl"),
    ("You should have received a copy of the GNU Lesser General Public License along", "lgpl"),
    ("See http://www.gnu.org/licenses/gpl-3.0.html", "gpl-3"),
    ("you may not use this file except in compliance with the License.", "apache-2"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2"),
    ("WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache-2"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1", "mpl-1.1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", None),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost-1.0"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost-1.0"),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications", "zlib"),
    ("The origin of this software must not be misrepresented;", "zlib"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights", "cc0-1.0"),
    ("http://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"),
    ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0-1.0"),
    ("This product includes software developed by the OpenSSL Project", "openssl"),
    ("for any purpose, without fee: permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "postgresql"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"),
    ("under the same terms as Perl itself", "artistic-1"),
    ("This document is confidential and proprietary", "proprietary"),
    ("may not be reproduced or transmitted in any form without the prior written permission", "proprietary"),
    ("a warranty and a hereby stand alone, liable to anyone", None),
    ("permission is granted to the reader", None),
]


def test_sentences_have_their_label(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "doc_id long, text string")).collect()}
    for i, (said, label) in enumerate(SAID):
        assert label is None or label in got[i].labels.split(","), (said, got[i].labels)
    assert got[len(SAID) - 1].labels == got[len(SAID) - 2].labels == ""
    assert len(licenses._sentences()) > 100


def test_every_sentence_passes_the_gate(spark, monkeypatch):
    fill = lambda p: re.sub(r"\(\?:([^()|]*)[^()]*\)(?:\{[\d,]+\})?", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", p))
    texts = []
    for _, _, t in licenses._sentences():
        while (shorter := fill(t)) != t:
            t = shorter
        texts.append("x, " + re.sub(r"(.)\?", r"\1", t.replace("[sc]", "s").replace("[sz]", "s").replace("[^ ]+", "word")).upper().replace(" ", " - ") + "!")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    gated = found()
    assert sum(bool(x) for x, _ in gated.values()) > 0.9 * len(texts)
    monkeypatch.setattr(licenses, "gate", lambda text: F.lit(True))
    assert gated == found()


def brute_detections(text):
    """Every place of every rule, settled in a plain loop."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    line = f" {' '.join(words)} "
    table = licenses.rules()
    found = []
    for i, (label, keyword, pattern, _, _) in enumerate(table):
        if keyword in words:
            for m in re.finditer(pattern, line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, -(start + m[0].count(" ") + 1), -(len(table) - i), label))
    kept, last = [], None
    for d in sorted(found):
        if last is None or d[0] >= -last[1]:
            if last:
                kept.append(last)
            last = d
        elif -d[1] > -last[1] and d[2] < last[2]:
            last = d
    return [(s, -e, label) for s, e, _, label in kept + ([last] if last else [])]


def test_detections_against_brute_force(spark):
    texts = [t for t, _ in SAID] + [" and ".join(t for t, _ in SAID[i : i + 4]) for i in range(0, len(SAID), 3)] + ["mit license " * 700, "under the mit license, " * 300 + "gpl version 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in licenses.scan_licenses(docs).collect():
        assert [tuple(d) for d in r.detections or []] == brute_detections(texts[r.doc_id]), texts[r.doc_id][:80]


def test_many_detections_are_linear(spark):
    took = []
    for n in (10_000, 20_000, 40_000):
        docs = spark.createDataFrame([(1, "under the mit license " * n)], "doc_id long, text string")
        began = time.time()
        assert licenses.scan_licenses(docs).select("n_base", F.size("detections")).first() == (n, n)
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 5, took


@pytest.mark.parametrize(("page", "texts"), [
    ("<p title=it's>next one</p>", ["next one"]),
    ('<img alt="5" tall">after', ["after"]),
    ('<p class="a>b">x</p><p title=\'a"b\'>y', ["x", "y"]),
    ("<p title=\"never closed>z</p>", ["z"]),
    ("a < b <c", ["a < b"]),
    ("<div><p>one<div>two</div></p></section>three", ["one", "two", "three"]),
    ("<a href=x?a=b&c='d'>link</a> text", ["link text"]),
    ("x<script src=a>no</script>y", ["xy"]),
])
def test_no_markup_in_text(page, texts):
    assert [b.text for b in html_text.blocks(page)] == texts


@pytest.mark.parametrize("piece", ["<a ", "a<b", "<a '", '<a x="', '<a x=">" ', "<div>", "<div>t", "</p>", "<p></div>", "<!--", "<script>", "&", "<a x=", "<>", "< ", "<td>x</p>"])
def test_tokens_are_linear(piece):
    took = []
    for n in (250_000, 1_000_000):
        page = piece * (n // len(piece))
        began = time.time()
        html_text.blocks(page)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1, took
