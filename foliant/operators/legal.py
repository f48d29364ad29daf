"""Legal definitions and coreference: defined terms, their canonical names, and texts with terms replaced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shared import dealt
from foliant.operators.text import NO_LETTER, arrow_group, arrow_pattern, arrow_spans

# What a kind of definition is called and how sure it is, by number; terms of each type; words that are no terms.
KINDS = (
    ("parenthetical_reference", 0.95),
    ("parenthetical_reference", 0.95),
    ("quoted_definition", 0.90),
    ("unquoted_definition", 0.80),
    ("unquoted_definition", 0.80),
    ("contextual_definition", 0.85),
    ("corporate_structure", 0.85),
    ("document_reference", 0.90),
    ("party_reference", 0.75),
    ("section_reference", 0.70),
    ("capitalized_term", 0.75),
)
ENTITY_TERMS = (
    "company", "corporation", "employer", "client", "customer", "vendor", "supplier", "contractor", "provider", "licensee", "licensor",
    "buyer", "seller", "borrower", "lender", "subsidiary", "affiliate", "parent", "holding company", "joint venture", "partnership",
    "entity", "organization", "employee", "team member", "staff", "personnel", "worker", "officer", "director", "manager", "executive",
    "representative", "agent", "consultant", "advisor", "member", "party", "parties", "counterparty", "participant", "stakeholder",
    "beneficiary", "trustee", "assignee", "successor",
)
DOCUMENT_TERMS = (
    "agreement", "contract", "terms", "conditions", "policy", "procedure", "guidelines", "manual", "document", "exhibit", "schedule",
    "attachment", "addendum", "amendment",
)
NOISE = ("the", "this", "that", "such", "any", "all", "each")
# Phrases and connectives in a definition's words, and what they add to its confidence.
PHRASES = (("shall mean", 0.10), ("for purpose of this", 0.08), ("for purposes of this", 0.08), ("as used herein", 0.08))
THIS_BRACKET, A_CORPORATION = 0.05, 0.05
CONNECTIVES, CONNECTED = ("and", "or", "but", "however", "therefore"), -0.02
LONG, TOO_LONG = 200, -0.05

# Places that may define a term are found by one pattern; what stands before and behind each decides what it defines.
NAME = r"[A-Z][a-z]+"
FIRM = rf",\s*a\s+{NAME}\s+(?:corporation|company|LLC|partnership)\b"
ANCHOR = "|".join(
    (
        r"\((?:the\s+)?\"[^\"]+\"\)",
        r"\(as\s+defined\s+in\s+Section\s+\d[\d.]*\)",
        r"\b(?:shall\s+)?(?:means?|refers?(?:\s+to)?|includes?)\b",
        FIRM,
        rf"\bbetween\s+{NAME}\s+and\s+{NAME}\b",
    )
)
BEFORE, BEHIND = 120, 110  # characters looked at
TITLE_END, CAPITALS_END, QUOTED_END = rf"({NAME}(?:\s+{NAME})*)\s*$", r"\bthe\s+([A-Z][A-Z\s]{2,})\s$", r"\"([^\"]+)\"\s+$"
INTRODUCED_END = rf"(?:As\s+used\s+herein|For\s+purposes?\s+of\s+this\s+\w+),\s*{TITLE_END}"
DOCUMENT_END = r"THIS\s+([A-Z\s]+)$"
MEANING = r"^\s+([^\n]{1,100}?)[.;,]"


# Parts between commas, quotes or brackets that are more than blanks: the last one, and the one before it.
PART = r"[^,\"()]*[^,\"() ]"
LAST_PART, PART_BEFORE = rf"(?:^|[,\"()])(?P<v>{PART} *)[ ,\"()]*$", rf"(?:^|[,\"()])(?P<v>{PART}) *(?:[,\"()] *)+[^,\"() ][^,\"()]*[ ,\"()]*$"
AROUND = "pattern_idx int, term string, canonical string, context string, confidence double"


def _preceding(before: pa.Array) -> pa.Array:
    """The party named right before a place: the last part between commas, quotes or brackets, or the one before "a ...".

    Its last run of capitalised words is taken, else the whole part.
    """
    last = pc.fill_null(arrow_group(before, LAST_PART), "")
    part = pc.utf8_trim(pc.if_else(pc.match_substring_regex(last, r"^\s*an? "), pc.coalesce(arrow_group(before, PART_BEFORE), last), last), " ")
    who = pc.utf8_trim(arrow_group(part, r"(?:^| )(?P<v>(?:[A-Z][A-Za-z0-9_&]* ?)+)$"), " ")
    return pc.if_else(pc.fill_null(pc.equal(who, ""), True), part, who)


def definition_confidence(base: pa.Array, context: pa.Array) -> pa.Array:
    """Base by kind, changed by phrases in the defining words and lowered if they are long; not yet cut at 1."""
    low = pc.utf8_lower(pc.replace_substring_regex(context, r"\s+", " "))
    changes = [(pc.greater(pc.utf8_length(context), LONG), TOO_LONG), *[(pc.match_substring(low, phrase), change) for phrase, change in PHRASES]]
    changes += [(pc.match_substring_regex(low, p), change) for p, change in ((r"this \w+ ?\(", THIS_BRACKET), (r"a \w+ corporation", A_CORPORATION), (rf"(?:^|\W)(?:{'|'.join(CONNECTIVES)})(?:\W|$)", CONNECTED))]
    for there, change in changes:
        base = pc.add(base, pc.if_else(there, change, 0.0))
    return base


def classify_keyword(term: Column) -> Column:
    low = F.lower(term)
    return F.when(low.isin(*ENTITY_TERMS), "entity").when(low.isin(*DOCUMENT_TERMS), "document").otherwise("other")


def pattern_label(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name, _ in KINDS]), idx + 1)


def _whole(pattern: str) -> str:
    """An ``arrow_pattern`` whose match, without the sign before a word boundary, is a group of its own."""
    named = arrow_pattern(pattern)
    lead = f"(?:^|{NO_LETTER})"
    return f"{lead}(?P<all>{named[len(lead):]})" if pattern.startswith(r"\b") else f"(?P<all>{named})"


def _defined(match: pa.Array, before: pa.Array, behind: pa.Array) -> pa.Table:
    """The definitions around places: ``at`` (the place's number) and the columns of ``AROUND``, in order of place and kind."""
    opened, firm, party, quotes = pc.starts_with(match, "("), pc.starts_with(match, ","), pc.starts_with(match, "between"), pc.match_substring(match, '"')
    bracket, section = pc.and_(opened, quotes), pc.and_not(opened, quotes)
    said = pc.invert(pc.or_(opened, pc.or_(firm, party)))
    parts: list[tuple] = []

    def add(number: int, at: pa.Array, term: pa.Array, canonical: pa.Array, context: pa.Array, there: pa.Array | None = None) -> None:
        rows = (at, pa.array(np.full(len(at), number, np.int32)), term, canonical, context)
        parts.append(rows if there is None else tuple(c.filter(there) for c in rows))

    def chosen(which: pa.Array) -> tuple[pa.Array, ...]:
        at = pa.array(np.flatnonzero(which.to_numpy(zero_copy_only=False)))
        return at, match.take(at), before.take(at)

    join = lambda *texts: pc.binary_join_element_wise(*texts, "")
    at, m, b = chosen(pc.or_(bracket, firm))
    who, context, quoted = _preceding(b), join(arrow_group(b, r'(?P<v>[^"(]*)$'), m), pc.fill_null(arrow_group(m, r'"(?P<v>[^"]+)"'), "")
    is_firm, the = pc.starts_with(m, ","), pc.starts_with(m, "(the")
    add(0, at, quoted, who, context, pc.invert(pc.or_(is_firm, the)))
    add(1, at, quoted, who, context, the)
    add(6, at, pc.fill_null(arrow_group(m, rf"(?P<v>{NAME}\s+\w+)$"), ""), who, context, is_firm)
    document = pc.extract_regex(b, _whole(DOCUMENT_END))
    add(7, at, quoted, pc.struct_field(document, "v"), join(pc.struct_field(document, "all"), m), pc.and_(pc.invert(is_firm), document.is_valid()))
    at, m, b = chosen(party)
    name = pc.fill_null(arrow_group(m, rf"between\s+(?P<v>{NAME})"), "")
    add(8, at, name, name, m)
    at, m, b = chosen(section)
    title = pc.extract_regex(b, _whole(TITLE_END))
    add(9, at, pc.struct_field(title, "v"), pc.struct_field(title, "v"), join(pc.struct_field(title, "all"), m), title.is_valid())
    # a term right before a verb, with its meaning behind it
    meaning = pc.extract_regex(behind, _whole(MEANING))
    at, m, b = chosen(pc.and_(said, meaning.is_valid()))
    meaning = meaning.take(at)
    means, refers, includes = (pc.match_substring_regex(m, verb) for verb in (r"^(?:shall\s+)?means?$", r"^refers?\s+to$", r"^includes?$"))
    for number, end, verbs in ((2, QUOTED_END, None), (3, TITLE_END, means), (4, TITLE_END, pc.or_(refers, includes)), (5, INTRODUCED_END, pc.or_(means, refers)), (10, CAPITALS_END, pc.or_(pc.or_(means, refers), includes))):
        term = pc.extract_regex(b, _whole(end))
        add(number, at, pc.struct_field(term, "v"), pc.struct_field(meaning, "v"), join(pc.struct_field(term, "all"), m, pc.struct_field(meaning, "all")), term.is_valid() if verbs is None else pc.and_(term.is_valid(), verbs))
    at, number, term, canonical, context = (pa.concat_arrays([p[i] for p in parts]) for i in range(5))
    canonical = pc.replace_substring_regex(pc.utf8_trim(pc.replace_substring_regex(canonical, r"\s+", " "), " "), r"[.,;:]+$", "")
    sure = definition_confidence(pa.array([base for _, base in KINDS]).take(number), context)
    rows = pa.table([at, number, pc.utf8_trim(term, " "), canonical, context, sure], names=["at", *[c.split()[0] for c in AROUND.split(", ")]])
    return rows.sort_by([("at", "ascending"), ("pattern_idx", "ascending")])


def all_definitions(texts: DataFrame) -> DataFrame:
    """Every definition in (source, text): the text is scanned once for anchors, each gives the definitions around it.

    Places are found and what stands around them is read by Arrow, a batch at a time.
    """
    around = arrow_spans(texts.select("source", "text"), "text", ANCHOR, BEFORE, BEHIND)

    @F.arrow_udf(f"array<struct<{AROUND}>>")
    def defined(match: pa.Array, before: pa.Array, behind: pa.Array) -> pa.Array:
        rows = _defined(match, before, behind).combine_chunks()
        ends = np.cumsum(np.bincount(rows["at"].to_numpy(), minlength=len(match)))
        columns = rows.select(range(1, rows.num_columns))
        values = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.columns], names=columns.column_names)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)

    found = around.select("source", "start", F.explode(defined("match", "before", "behind")).alias("r"))
    out = found.select("source", F.lower("r.term").alias("keyword"), F.col("r.canonical").alias("canonical_name"), "r.context", "r.pattern_idx", F.round(F.least("r.confidence", F.lit(1.0)), 6).alias("confidence"), "start")
    good = out.where((F.length("keyword") > 1) & (F.length("canonical_name") > 2) & ~F.col("keyword").isin(*NOISE))
    return good.select("source", "keyword", "canonical_name", classify_keyword(F.col("keyword")).alias("keyword_type"), "context", "confidence", "pattern_idx", pattern_label(F.col("pattern_idx")).alias("pattern_type"), "start")


def best_definitions(definitions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Per source and keyword the most confident definition, the first one on ties; dealt out by the texts they were found in, if given."""
    definitions = definitions if texts is None else dealt(definitions, texts, "source")
    w = Window.partitionBy("source", "keyword").orderBy(F.desc("confidence"), "pattern_idx", "start")
    return definitions.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def extract_definitions(texts: DataFrame) -> DataFrame:
    return best_definitions(all_definitions(texts), texts)


def document_text(chunks: DataFrame) -> DataFrame:
    """Chunks of a source joined by a blank, in order."""
    return chunks.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def replace_keywords(chunks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Whole-word terms of the entity kind become their canonical names, longest term first; adds ``replaced``.

    All terms of a source are one pattern, so a text is read once and a name that was put in is not replaced again.
    """
    from foliant.operators.text import literal, replaced_once

    terms = definitions.where("keyword_type = 'entity'").groupBy("source", F.lower("keyword").alias("k")).agg(F.min("canonical_name").alias("canon"))
    listed = terms.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.length("k")).alias("n"), "k", "canon"))).alias("__d"))
    pattern = F.concat(F.lit(r"(?i)\b(?:"), F.array_join(F.transform("__d", lambda d: literal(d["k"])), "|"), F.lit(r")\b"))
    known = listed.select("source", pattern.alias("__p"), F.map_from_entries(F.transform("__d", lambda d: F.struct(d["k"], d["canon"]))).alias("__m"))
    joined = chunks.join(known.hint("merge"), "source", "left")
    new = F.when(F.col("__p").isNull(), F.col("text")).otherwise(replaced_once(F.col("text"), F.col("__p"), lambda m: F.try_element_at("__m", F.lower(m))))
    put = joined.select(*chunks.columns, new.alias("__new"))  # a step of its own, as it is used twice
    return put.select(*[c for c in chunks.columns if c != "text"], F.col("__new").alias("text"), (F.col("__new") != F.col("text")).alias("replaced"))


def process_chunks(chunks: DataFrame) -> DataFrame:
    return replace_keywords(chunks, extract_definitions(document_text(chunks)))


def keyword_entities(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.lit("legal_keywords").alias("entity_type"), F.upper("keyword").alias("name"), "source", "canonical_name", "confidence")


def _relations() -> list[Column]:
    """(type, target) of a definition: ``defined_in`` for all terms, ``refers_to`` for the entity kind, else null."""
    kind = lambda name, target: F.struct(F.lit(name).alias("type"), F.col(target).alias("target"))
    return [kind("defined_in", "source"), F.when(F.col("keyword_type") == "entity", kind("refers_to", "canonical_name"))]


def keyword_relations(definitions: DataFrame) -> DataFrame:
    """``defined_in`` for all terms, ``refers_to`` for the entity kind; the definitions are read once."""
    found = definitions.select("source", "keyword", "confidence", F.explode(F.array(*_relations())).alias("r")).where("r is not null")
    return found.select(F.upper("keyword").alias("source_entity"), F.col("r.target").alias("target_entity"), F.col("r.type").alias("relationship_type"), F.col("source").alias("source_document"), "confidence")


def keyword_entities_and_relations(definitions: DataFrame) -> DataFrame:
    """Both in one table, from one reading of the definitions: kind, source, name, other, type, confidence."""
    entity = F.struct(F.lit("legal_keywords").alias("type"), F.col("canonical_name").alias("target"))
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), r.alias("r")) for kind, r in [("entity", entity), *[("relation", r) for r in _relations()]]])
    found = definitions.select("source", "keyword", "confidence", F.explode(rows).alias("row")).where("row.r is not null")
    return found.select("row.kind", "source", F.upper("keyword").alias("name"), F.col("row.r.target").alias("other"), F.col("row.r.type").alias("type"), "confidence")
