"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

A text is scanned as its lower-case words joined by single blanks. A cheap gate on the raw text, made from the keywords
of the rules, lets few documents through, and all that a rule can match; of the rules (sentences of license texts, headers and notices, and each license
name in each kind of notice), only those whose keyword occurs are matched. Of
overlapping detections the longer encloses the shorter, equal ones are settled by priority, and of two that overlap in
part the one of higher priority stays.

Defined cases: a null or empty text has no words and no labels; repeated rows get equal results; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_ANY_CASE = r"[a-zA-Z0-9\x80-\x{10FFFF}]+"  # the most frequent range first, as Java tests them in turn
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the contract: base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_KEYWORDS = ("cc",)  # of the base phrases without the word license
# License names as they stand between single blanks, by label: (keyword, pattern).
_VERSIONED = {
    "gpl": ("gpl", "gnu gpl|gpl", "(?:gnu )?general public licen[sc]e", "general", ("1", "2", "3")),
    "lgpl": ("lgpl", "gnu lgpl|lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "general", ("2", "2 1", "3")),
    "agpl": ("agpl", "gnu agpl|agpl", "(?:gnu )?affero general public licen[sc]e", "affero", ("1", "3")),
    "apache": ("apache", "apache", "apache (?:software )?licen[sc]e", "apache", ("1", "1 1", "2")),
    "mpl": ("mpl", "mpl", "mozilla public licen[sc]e", "mozilla", ("1", "1 1", "2")),
    "epl": ("epl", "epl", "eclipse public licen[sc]e", "eclipse", ("1", "2")),
    "cddl": ("cddl", "cddl", "common development and distribution licen[sc]e", "distribution", ("1", "1 1")),
    "eupl": ("eupl", "eupl", "european union public licen[sc]e", "european", ("1", "1 1", "1 2")),
    "osl": ("osl", "osl", "open software licen[sc]e", "open", ("1", "2", "2 1", "3")),
    "afl": ("afl", "afl", "academic free licen[sc]e", "academic", ("2", "2 1", "3")),
    "artistic": ("artistic", "artistic", "artistic licen[sc]e", "artistic", ("1", "2")),
}
_PLAIN = {
    "mit": ("mit", "(?:the )?mit(?: x11)?"),
    "isc": ("isc", "isc"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "bsd-2-clause": ("bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    "bsd-3-clause": ("bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    "bsd-4-clause": ("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    "bsd": ("bsd", "bsd"),
    "unlicense": ("unlicense", "unlicense"),
    "wtfpl": ("wtfpl", "wtfpl"),
    "cc0-1.0": ("cc0", "(?:creative commons )?cc0(?: 1 0)?"),
    "public-domain": ("public", "public domain"),
    "boost-1.0": ("boost", "boost software(?: licen[sc]e)?(?: version)?(?: 1 0)?"),
    "postgresql": ("postgresql", "postgresql"),
    "openssl": ("openssl", "openssl"),
    "ms-pl": ("microsoft", "microsoft public"),
    "ofl-1.1": ("font", "(?:sil )?open font"),
    "odbl": ("odbl", "odbl"),
}
_CC = {
    "by": "by|attribution",
    "by-sa": "by sa|attribution share ?alike",
    "by-nd": "by nd|attribution no ?deriv(?:ative)?s",
    "by-nc": "by nc|attribution non ?commercial",
    "by-nc-sa": "by nc sa|attribution non ?commercial share ?alike",
    "by-nc-nd": "by nc nd|attribution non ?commercial no ?deriv(?:ative)?s",
}
SENTENCE_PRIORITY, SENTENCE_CONFIDENCE = 10, 0.99
BLOCK = 256
# Kinds of notices: (pattern with the name at {}, priority, confidence).
_NOTICES = (
    ("spdx licen[sc]e identifier {}", 9, 1.0),
    ("(?:is |are )?(?:dual )?licen[sc]ed under (?:the |a )?(?:terms of )?(?:the )?{}", 8, 0.98),
    ("(?:released|distributed|published|available|provided) under (?:the |a )?(?:terms of )?(?:the )?{}", 7, 0.95),
    ("under the terms of (?:the )?{}", 6, 0.9),
    ("{} licen[sc]e", 4, 0.8),
    ("{}", 2, 0.5),
)


# Sentences of license texts, headers and notices, as lower-case words: (label, a word of it that the prefilter looks for, pattern).
_SENTENCES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("mit", "opensource", "opensource org licen[sc]es? mit"),
    ("isc", "hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "opensource", "opensource org licen[sc]es? isc"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "warranties", "this software is provided by (?:the )?(?:[^ ]+ ){1,10}as is and any express or implied warranties"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "opensource", "opensource org licen[sc]es? bsd 2 clause"),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,10}nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "opensource", "opensource org licen[sc]es? bsd 3 clause"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", "redistribute", "this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "warranty", "(?:this program )?is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", "this (?:library|program|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "gnu", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "redistribute", "this (?:program|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("agpl", "gnu", "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("apache-2", "apache", "licen[sc]ed under the apache licen[sc]e version 2(?: 0)? the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", "apache", "(?:http|https) www apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", "applicable", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2", "warranties", "without warranties or conditions of any kind either express or implied"),
    ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-1.1", "developed", "this product includes software developed by the apache software foundation"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0"),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("epl-1", "eclipse", "(?:this program and the accompanying materials )?(?:are|is) made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?1 0"),
    ("epl-2", "eclipse", "(?:this program and the accompanying materials )?(?:are|is) made available under the terms of the eclipse public licen[sc]e (?:v(?:ersion)? ?)?2 0"),
    ("cddl-1", "distribution", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("boost-1.0", "hereby", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("boost-1.0", "boost", "distributed under the boost software licen[sc]e version 1 0"),
    ("zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "anyone", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "relinquishment", "an overt act of relinquishment in perpetuity of all present and future rights"),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public licen[sc]e)?"),
    ("cc0-1.0", "waived", "to the extent possible under law (?:[^ ]+ ){1,10}waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", "dedicated", "has dedicated the work to the public domain by waiving all of"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("postgresql", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ms-pl", "patent", "each contributor grants you a non exclusive worldwide royalty free (?:copyright|patent) licen[sc]e"),
    ("ofl-1.1", "font", "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"),
    ("ofl-1.1", "reserved", "no modified version of the font software may use the reserved font name"),
    ("artistic-2", "artistic", "you may distribute (?:this|it) under the terms of (?:either )?the artistic licen[sc]e 2 0"),
    ("artistic-1", "perl", "under the same terms as perl itself"),
    ("odbl", "database", "this (?:[^ ]+ ){1,6}is made available under the open database licen[sc]e"),
    ("proprietary", "confidential", "this (?:document|file|software) (?:is|contains) (?:the )?confidential and proprietary"),
    ("proprietary", "reproduced", "may not be (?:copied|reproduced)(?: or| and)?(?: [^ ]+){0,4} without (?:the )?(?:express |prior )?written (?:permission|consent)"),
)


def _sentences() -> list[tuple[str, str, str]]:
    """(label, keyword, pattern) of the sentences, the notices of the Free Software Foundation and the addresses of licenses."""
    out = list(_SENTENCES)
    for family, middle in (("gpl", ""), ("lgpl", "(?:lesser|library) "), ("agpl", "affero ")):
        for v in _VERSIONED[family][-1]:
            number = rf"{v}(?: 0)?" if " " not in v else v
            name = f"gnu {middle}general public licen[sc]e"
            out.append((f"{family}-{v.replace(' ', '.')}", "gnu", f"(?:under the terms of )?the {name} as published by the free software foundation (?:either )?version {number}(?: of the licen[sc]e)?(?: only| or (?:at your option )?any later version)?"))
            out.append((f"{family}-{v.replace(' ', '.')}", "gnu", f"gnu org licen[sc]es (?:old licen[sc]es )?{family} {number}"))
    for kind in _CC:
        for v in ("1", "2", "2 5", "3", "4"):
            number = v if " " in v else f"{v} 0"
            out.append((f"cc-{kind}-{number.replace(' ', '.')}", "creativecommons", f"creativecommons org licen[sc]es {kind.replace('-', ' ')} {number}"))
    return out


def _names() -> list[tuple[str, str, str]]:
    """(label, keyword, pattern) of every license name."""
    out = []
    for family, (short, abbreviated, name, word, versions) in _VERSIONED.items():
        for v in versions:
            number = rf"(?:version |v )?v?{v}{'(?: 0)?' if ' ' not in v else ''}(?: or later| only)?"
            label = f"{family}-{v.replace(' ', '.')}"
            out += [(label, word, f"{name} {number}"), (label, short, f"(?:{abbreviated}) {number}")]
            if family in ("gpl", "lgpl", "agpl", "mpl"):
                out.append((label, f"{short}v{v.split()[0]}", f"{short}v{v}"))
    out += [(label, keyword, name) for label, (keyword, name) in _PLAIN.items()]
    for kind, name in _CC.items():
        for v in ("1", "2", "2 5", "3", "4"):
            number = v if " " in v else f"{v} 0"
            tail = rf"(?: (?:{name})(?: licen[sc]e)?(?: version)? {number}(?: international| unported| generic)?)"
            out += [(f"cc-{kind}-{number.replace(' ', '.')}", word, lead + tail) for word, lead in (("cc", "(?:creative commons )?cc"), ("commons", "creative commons"))]
    return out


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules in order: (label, keyword, pattern, priority, confidence). A bare word is no notice without the word licence."""
    plain = {label for label in _PLAIN if label not in ("unlicense", "wtfpl", "cc0-1.0", "odbl", "public-domain")}
    out = [(label, keyword, f"(?<= ){sentence}(?= )", SENTENCE_PRIORITY, SENTENCE_CONFIDENCE) for label, keyword, sentence in _sentences()]
    for notice, priority, confidence in _NOTICES:
        for label, keyword, name in _names():
            if notice == "{}" and label in plain:
                continue
            out.append((label, keyword, f"(?<= ){notice.format(name)}(?= )", priority, confidence))
    return out


def gate(text: Column) -> Column:
    """Whether a raw text may match a rule or a base phrase: all words that one needs occur in it.

    A pattern needs "licen[sc]" or its keyword; with the keyword it needs "under", or all of itself if it has no variants.
    """
    alone, under = set(BASE_KEYWORDS), set()
    for _, keyword, pattern, priority, _ in rules():
        body = needed = pattern.removeprefix("(?<= )").removesuffix("(?= )")
        while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", needed)) != needed:
            needed = shorter
        if "licen[sc]" in needed:
            continue
        if priority == SENTENCE_PRIORITY:
            alone.add(keyword)
            continue
        if "under " in needed:
            under.add(keyword)
        else:
            alone.add(body if re.fullmatch("[a-z0-9 ]+", body) else keyword)
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    has = lambda phrases: F.rlike(text, F.lit(rf"(?i)(?:^|{between})(?:{'|'.join(sorted(phrases)).replace(' ', between + '+')})(?:{between}|$)"))
    return F.rlike(text, F.lit("(?i)licen[sc]")) | has(alone) | (has({"under"}) & has(under - alone))


def _rule_blocks(table: list[tuple[str, str, str, int, float]]) -> Column:
    """One string per keyword: the keyword, then a line per rule (pattern, label, minus its rank, confidence)."""
    blocks: dict[str, list[str]] = {}
    for i, (label, keyword, pattern, _, confidence) in enumerate(table):
        blocks.setdefault(keyword, [keyword]).append(f"{pattern}\t{label}\t{-(len(table) - i)}\t{confidence}")
    return F.split(F.lit("\r".join("\n".join(b) for b in blocks.values())), "\r")


def _field(line: Column, mark: str, n: int) -> Column:
    return F.split_part(line, F.lit(mark), F.lit(n))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Numbers of the blocks of an array, and what gives a block. A list that an aggregation grows is copied at every step,
    so it must not hold more than a block."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))


def _places(text: Column, pattern: Column) -> Column:
    """(start, end) in words, end exclusive, of every match; the blanks before a match count the words before it."""
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    matches, gaps = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), blanks), F.transform(F.split(text, pattern, -1), blanks)
    pairs = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda p: p["m"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["g"]
        place = F.struct((start - 1).alias("start"), (start + x["m"]).alias("end"))
        return F.struct((start + x["m"]).alias("at"), F.concat(s["out"], F.array(place)).alias("out"))

    def inside(pairs: Column) -> Column:
        numbers, block = _blocks(pairs)
        return F.transform(numbers, lambda b: F.aggregate(block(b), F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    def moved(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(parts, zero, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(parts, before, lambda p, n: F.transform(p["out"], lambda x: F.struct((x["start"] + n).alias("start"), (x["end"] + n).alias("end")))))

    return _let(_let(pairs, inside), moved)


def _settled(found: Column) -> Column:
    """Detections in order of start, longest first, then priority: what lies inside the last one kept is dropped.

    Block by block: first what is last at the beginning of each, then what each keeps.
    """
    kind = "struct<start:int,less:int,low:int,label:string,confidence:double>"
    none, empty = F.lit(None).cast(kind), F.array().cast(f"array<{kind}>")
    apart = lambda last, d: last.isNull() | (d["start"] >= -last["less"])
    after = lambda last, d: F.when(apart(last, d) | ((-d["less"] > -last["less"]) & (d["low"] < last["low"])), d).otherwise(last)

    def step(s: Column, d: Column) -> Column:
        last = s["last"]
        out = F.when(apart(last, d) & last.isNotNull(), F.concat(s["out"], F.array(last))).otherwise(s["out"])
        return F.struct(out.alias("out"), after(last, d).alias("last"))

    def kept(every: Column) -> Column:
        numbers, block = _blocks(every)
        begin = F.struct(empty.alias("first"), none.alias("last"))
        carried = F.aggregate(numbers, begin, lambda s, b: F.struct(F.concat(s["first"], F.array(s["last"])).alias("first"), F.aggregate(block(b), s["last"], after).alias("last")))
        parts = lambda c: F.zip_with(numbers, c["first"], lambda b, last: F.aggregate(block(b), F.struct(empty.alias("out"), last.alias("last")), step, lambda s: s["out"]))
        return _let(carried, lambda c: F.concat(F.flatten(parts(c)), F.when(c["last"].isNotNull(), F.array(c["last"])).otherwise(empty)))

    return _let(F.sort_array(found), kept)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections (start, end, label)."""
    text = F.coalesce("text", F.lit(""))
    table = rules()
    keywords = "|".join(sorted({k for _, k, *_ in table}, key=lambda k: (-len(k), k)))
    gated = docs.select("doc_id", text.alias("text"), F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    joined = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD_ANY_CASE), F.lit(0)), " "), F.lit(" "))
    lined = gated.select("doc_id", "n_words", F.when(gate(F.col("text")), joined).alias("line"))
    seen = lined.select("doc_id", "n_words", "line", F.array_distinct(F.regexp_extract_all("line", F.lit(f"(?<= )({keywords})(?= )"), F.lit(1))).alias("seen"))
    due = F.filter(F.flatten(F.transform(F.filter(_rule_blocks(table), lambda b: F.array_contains(F.col("seen"), _field(b, "\n", 1))), lambda b: F.slice(F.split(b, "\n"), 2, len(table)))), lambda r: F.rlike("line", _field(r, "\t", 1)))
    spans = lambda r: F.transform(
        _places(F.col("line"), _field(r, "\t", 1)),
        lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("less"), _field(r, "\t", 3).cast("int").alias("low"), _field(r, "\t", 2).alias("label"), _field(r, "\t", 4).cast("double").alias("confidence")),
    )
    base = F.filter(F.array(*[F.struct(F.lit(f"(?<= ){p}(?= )").alias("pattern"), F.lit(n).alias("label")) for p, n in BASE.items()]), lambda r: F.rlike("line", r["pattern"]))
    base = F.flatten(F.transform(base, lambda r: F.transform(_places(F.col("line"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), r["label"].alias("label")))))
    has = F.col("line").isNotNull() & (F.size("seen") > 0)
    found = seen.select("doc_id", "n_words", F.when(F.col("line").isNotNull(), base).alias("base"), F.when(has, _settled(F.flatten(F.transform(due, spans)))).alias("kept"))
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    blank = F.array().cast("array<string>")
    base_names = F.coalesce(F.transform("base", lambda b: b["label"]), blank)
    kept_names = F.coalesce(F.transform("kept", lambda k: k["label"]), blank)
    sure = F.array_max(F.concat(F.array(F.lit(0.0)), F.coalesce(F.transform("kept", lambda k: k["confidence"]), F.array().cast("array<double>")), F.when(F.size(base_names) > 0, F.array(F.lit(0.95))).otherwise(F.array().cast("array<double>"))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base_names).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).cast("long").alias("last_word"),
        names(base_names).alias("base_labels"),
        names(F.concat(base_names, kept_names)).alias("labels"),
        sure.alias("score"),
        F.transform("kept", lambda k: F.struct(k["start"].alias("start"), (-k["less"]).alias("end"), k["label"].alias("label"))).alias("detections"),
    )
