"""Entity and relation extraction with native spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.text import arrow_group, arrow_pattern, arrow_spans, context_window, regex_spans

# Words that close a company's name, forms of address, currencies, factors, verbs by type of relation, and
# the words that lead to an attribute.
LEGAL_FORMS = ("Inc", "Corp", "LLC", "Ltd", "Corporation", "Company", "Co")
TRADES = ("System", "Systems", "Solution", "Solutions", "Service", "Services", "Technology", "Technologies")
FORMS_OF_ADDRESS = ("Dr", "Mr", "Ms", "Mrs")
CURRENCIES = ("USD", "EUR", "GBP", "dollars", "dollar", "euros", "euro", "pounds", "pound")
FACTORS = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "k": 1e3, "m": 1e6, "b": 1e9}
NUMBER, SCALE = r"\d[\d,]*(?:\.\d+)?", r"(?:\s*(?:" + "|".join(FACTORS) + r")\b)?"
MONEY = (rf"(?i)\${NUMBER}{SCALE}", rf"(?i)\b{NUMBER}{SCALE}\s*(?:{'|'.join(CURRENCIES)})\b")
OFFICES = ("CEO", "CTO", "CFO", "COO", "President", "Director", "Manager", "VP", "Vice President")
RANKS = ("Senior", "Principal", "Lead")
DEPARTMENTS = ("Human Resources", "Human Resource", "HR", "Engineering", "Finance", "Legal", "Marketing", "Sales", "Operations", "IT", "Information Technology", "Security", "Compliance")

WORD = r"[A-Z][a-z]+"  # a capitalised word
CLOSING = rf"\b(?:{'|'.join(LEGAL_FORMS + TRADES)})\b"
NAME_BEFORE = 72  # characters that may stand before the closing word
CONTEXT = 200  # characters on both sides of a name
LAST_RUN = r"([A-Z][A-Za-z\s&]*+)$"  # the same end, which the first match gives; nothing is tried twice
NAME_RUN = r"(?:^|[^A-Za-z\s&])[a-z\s&]*([A-Z][A-Za-z\s&]*)$"  # the end of a text from the first capital of its last run of letters
FORM = rf"\b(?:{'|'.join(FORMS_OF_ADDRESS)})\.?\s+"
PERSON = (rf"\b{WORD}(?:\s+{WORD}){{1,2}}\b", rf"{FORM}{WORD}\s+{WORD}\b")
CLAUSE, PLACE, COUNT, DOMAIN = r"[^.\n]+", r"[^.,\n]+", r"\d[\d,]*(?:-\d[\d,]*)?", r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SUM = NUMBER + r"(?:\s*(?:million|billion|m|b)\b)?"


def labelled(cues: str, value: str) -> str:
    """``cue: value``."""
    return rf"(?i)\b(?:{cues})\s*:\s*({value})"


def led_by(cues: str, value: str) -> str:
    """``cue value``."""
    return rf"(?i)\b(?:{cues})\s+({value})"


def follows(cues: str, value: str, mark: str = "") -> str:
    """A cue, and on the same line within 200 characters the value behind its mark."""
    return rf"(?i)\b(?:{cues})[^\n]{{0,200}}?{mark}({value})"


def followed_by(value: str, cues: str, gap: str = r"\s+", mark: str = "") -> str:
    """``value cue``, the value behind its mark."""
    return rf"(?i){mark}({value}){gap}(?:{cues})\b"


def one_of(values: tuple[str, ...]) -> str:
    return rf"(?i)\b({'|'.join(values)})\b"


EMPLOYEES, TURNOVER = "employees?|staff|workforce", "revenue|sales|income"
ATTRIBUTES = {
    "company": {
        "industry": (labelled("industry|sector|business", CLAUSE), led_by(r"specializes?\s+in|focuses\s+on", CLAUSE), led_by(r"provider\s+of|leader\s+in", CLAUSE)),
        "revenue": (follows(TURNOVER, SUM, r"\$"), followed_by(SUM, "revenue|annual|yearly", r"[^\n]{0,200}?", r"\$")),
        "employees": (follows(EMPLOYEES, COUNT), followed_by(COUNT, EMPLOYEES + "|people")),
        "location": (led_by(r"(?:headquartered|located|based)\s+in", PLACE), labelled("state|jurisdiction", WORD), followed_by(WORD, "corporation|corp|inc", mark=r"\b")),
        "legal_form": (one_of(("Inc", "Corporation", "Corp", "LLC", "Ltd", "Limited")), followed_by("Delaware|Nevada|California", "corporation|corp", mark=r"\b")),
        "jurisdiction": (followed_by(r"\w+", "corporation|company|partnership", mark=r"\ban?\s+"), led_by(r"incorporated\s+in", r"\w+")),
        "role": (r"\((?:the )?\"(\w+)\"\)",),
        "email_domain": (r"@([a-z0-9.-]+\.[a-z]+)",),
    },
    "person": {
        "title": (one_of(OFFICES), r"(?i)\b(Chief\s+\w+\s+Officer)\b", rf"(?i)\b((?:{'|'.join(RANKS)})\s+\w+)"),
        "department": (one_of(DEPARTMENTS),),
        "email_domain": (rf"@({DOMAIN})", r"\b([A-Za-z0-9-]+\.(?:com|org|net))\b"),
    },
    "financial": {"metric": (one_of(("revenue", "ebitda", "profit", "loss", "earnings", "income", "sales")), one_of(("assets", "liabilities", "equity", "debt"))), "period": (one_of(("annual", "yearly", "quarterly", "monthly")), r"(?i)\b(Q[1-4] ?\d{4}|FY ?\d{4}|Q[1-4])\b", r"\b(20\d\d)\b"), "currency": (r"(\$|USD|EUR|GBP)",)},
}
# Of these lower-case texts one must stand where a pattern hits, so it is only tried there.
CUES = {
    "company": {
        "industry": (("industry", "sector", "business"), ("specialize", "focuses"), ("provider", "leader")),
        "revenue": (tuple(TURNOVER.split("|")), ("revenue", "annual", "yearly")),
        "employees": (("employee", "staff", "workforce"), ("employee", "staff", "workforce", "people")),
        "location": (("headquartered", "located", "based"), ("state", "jurisdiction"), ("corp", "inc")),
        "legal_form": (("inc", "corp", "llc", "ltd", "limited"), ("delaware", "nevada", "california")),
        "jurisdiction": (("corporation", "company", "partnership"), ("incorporated",)),
        "role": (("\")",),),
        "email_domain": (("@",),),
    }
}
RELATIONS = {
    "ACQUIRED": "acquired|purchased|bought",
    "PARTNERSHIP": "partnered with|partnership with",
    "INVESTED_IN": "invested in",
    "EXECUTIVE_OF": "(?:CEO|CFO|CTO|President|Director)(?: of| at)?",
    "FOUNDED": "founded|established|created",
    "OWNS": "owns|controls",
    "SUBSIDIARY_OF": "subsidiary of|owned by",
}
BETWEEN_RUNS = r"[^\p{L}\p{N}_\s]+"
LEAST_RELATION_TEXT = 50
ENDINGS = (" and ", " or ", ", ", ";")


def first_attribute(text: Column, patterns: tuple[str, ...], low: Column | None = None, cues: tuple[tuple[str, ...], ...] = ()) -> Column:
    """Group 1 of the first pattern that hits, trimmed, else null; with ``cues`` (low: the text in lower case) a pattern is
    tried only where one of its cues stands."""
    hits = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    if cues:
        hits = [F.when(reduce(or_, [F.contains(low, F.lit(c)) for c in some]), hit) for hit, some in zip(hits, cues, strict=True)]
    return F.coalesce(*hits)


def normalise_amount(text: Column) -> Column:
    """Digits times the factor named right behind them (thousand, million, billion or k, m, b); null without digits."""
    digits = F.nullif(F.replace(F.regexp_extract(text, f"({NUMBER})", 1), F.lit(","), F.lit("")), F.lit(""))
    scale = F.lower(F.regexp_extract(text, rf"(?i){NUMBER}\s*({'|'.join(FACTORS)})\b", 1))
    factor = F.lit(1.0)
    for word, value in FACTORS.items():
        factor = F.when(scale == word, value).otherwise(factor)
    return digits.cast("double") * factor


def _spans(chunks: DataFrame, patterns: tuple[str, ...], n: int) -> DataFrame:
    """source, name, start, position, context of all patterns' matches; a name that two patterns find stays twice."""
    out = None
    for p in patterns:
        found = regex_spans(chunks.select("source", "text"), "text", p)
        part = found.select("source", F.trim("match").alias("name"), "start", F.round(F.col("start") / F.length("text"), 6).alias("position"), context_window(F.col("text"), F.col("start"), F.col("end"), n).alias("context"))
        out = part if out is None else out.unionByName(part)
    return out


def _with_attributes(found: DataFrame, kind: str) -> DataFrame:
    """The attributes of a kind that stand in the context, each by its first pattern that hits; Arrow reads a batch at a time."""
    patterns = {a: [arrow_pattern(p) for p in some] for a, some in ATTRIBUTES[kind].items()}

    @F.arrow_udf(", ".join(f"{a} string" for a in patterns))
    def read(context: pa.Array) -> pa.Array:
        hits = [[pc.utf8_trim(arrow_group(context, p), " ") for p in some] for some in patterns.values()]
        return pa.StructArray.from_arrays([pc.coalesce(*[pc.if_else(pc.equal(h, ""), None, h) for h in some]) for some in hits], names=list(patterns))

    known = found.select("*", read("context").alias("__a"))
    return known.select(*found.columns, *[F.col(f"__a.{a}").alias(a) for a in patterns])


def company_mentions(chunks: DataFrame) -> DataFrame:
    """source, name, start, position, context of every name that ends in a closing word.

    Closing words are looked for; from each the letters, blanks and ampersands before it are followed back to the first
    capital, so a text is scanned once and nothing is tried from every capital letter. A closing word inside a longer name
    ends a name of its own.
    """
    texts = chunks.select("source", F.length("text").alias("__n"), "text")
    found = arrow_spans(texts, "text", CLOSING, NAME_BEFORE + CONTEXT, CONTEXT)
    # a generator, as a condition on a column is worked out beside the column once more
    named = found.select("*", F.explode(F.array(F.regexp_extract(F.right("before", F.lit(NAME_BEFORE)), LAST_RUN, 1))).alias("lead")).where("lead <> ''")
    first = F.col("start") - F.length("lead")
    context = F.concat(F.right("before", F.length("lead") + CONTEXT), "match", "behind")
    place = named.select("source", F.trim(F.concat("lead", "match")).alias("name"), first.alias("start"), F.round(first / F.col("__n"), 6).alias("position"), context.alias("context"))
    return place.where(F.length("name").between(5, 80))


def extract_companies(chunks: DataFrame) -> DataFrame:
    return _with_attributes(company_mentions(chunks), "company")


def extract_people(chunks: DataFrame) -> DataFrame:
    """Names of two or three capitalised words and names behind a form of address, which is not part of the name."""
    parts = F.split("name", r"\s+")
    found = _with_attributes(_spans(chunks, PERSON, 200).withColumn("name", F.regexp_replace("name", FORM, "")), "person")
    middle = F.nullif(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), " "), F.lit(""))
    return found.select("*", F.get(parts, 0).alias("first_name"), middle.alias("middle_name"), F.element_at(parts, -1).alias("last_name"))


def extract_financials(chunks: DataFrame) -> DataFrame:
    found = _with_attributes(_spans(chunks, MONEY, 100), "financial")
    return found.select("source", "name", "start", "position", "context", normalise_amount(F.col("name")).alias("amount"), F.coalesce("currency", F.lit("USD")).alias("currency"), F.coalesce("metric", F.lit("amount")).alias("metric"), F.coalesce("period", F.lit("unspecified")).alias("period"))


def extract_rich_entities(chunks: DataFrame) -> DataFrame:
    """entity_type, name, source, context, confidence, extraction_method of all three kinds; short chunks are skipped."""
    long = chunks.where(F.length(F.trim("text")) >= 20)
    kinds = (("companies", extract_companies(long), 0.85), ("people", extract_people(long), 0.8), ("financial_metrics", extract_financials(long), 0.9))
    out = None
    for kind, found, confidence in kinds:
        part = found.select(F.lit(kind).alias("entity_type"), "name", "source", "start", "context", F.lit(confidence).alias("confidence"), F.lit("rich_pattern").alias("extraction_method"))
        out = part if out is None else out.unionByName(part)
    return out


def to_linkage_columns(companies: DataFrame) -> DataFrame:
    """The flat form for record linkage: one row per company row with a row key and empty-safe attributes."""
    return companies.select(F.substring(F.sha2(F.concat_ws("|", "source", "name", "start"), 256), 1, 16).alias("unique_id"), F.lower("name").alias("company_name"), "jurisdiction", "legal_form", "role", "source")


def _row_key(*parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16).alias("unique_id")


def people_linkage_columns(people: DataFrame) -> DataFrame:
    """The flat form of people: a row key, the name in parts, what they do, and where they were found."""
    return people.select(_row_key("source", "name", "start"), F.lower("name").alias("full_name"), "first_name", "middle_name", "last_name", "title", "department", "email_domain", F.length("name").alias("name_length"), "source")


def financial_linkage_columns(financials: DataFrame) -> DataFrame:
    """The flat form of amounts: a row key, the amount as text and number, what it measures, and where it was found."""
    return financials.select(_row_key("source", "name", "start"), F.col("name").alias("amount_text"), F.col("amount").alias("normalized_amount"), "currency", F.col("metric").alias("metric_type"), "period", "position", "source")


def enrich_entities(entities: DataFrame, chunks: DataFrame, kind: str = "company") -> DataFrame:
    """Attributes from the whole text of each entity's source."""
    text = chunks.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("__t"))
    return entities.join(text.hint("merge"), "source", "left").select(*entities.columns, *[first_attribute(F.col("__t"), p).alias(a) for a, p in ATTRIBUTES[kind].items()])


def document_entities(chunks: DataFrame) -> DataFrame:
    """One entity per source: its cleaned name and the start of its first chunk."""
    name = F.trim(F.replace(F.regexp_replace("source", r"\.(pdf|txt|md|docx)$", ""), F.lit("_"), F.lit(" ")))
    return chunks.groupBy("source").agg(F.min_by("text", "pos").alias("__t")).select(name.alias("name"), "source", F.substring("__t", 1, 200).alias("context"), F.lit(1.0).alias("confidence"))


def valid_company(name: Column) -> Column:
    return (F.length(name) >= 3) & name.rlike(r"[A-Z]") & ~name.rlike(r"^\d") & ~F.lower(name).isin("agreement", "company", "the company", "party")


def valid_person(name: Column) -> Column:
    """Two to four parts, each capitalised letters only."""
    parts = F.split(F.trim(name), r"\s+")
    return F.size(parts).between(2, 4) & F.forall(parts, lambda p: p.rlike(r"^[A-Z][a-z]*\.?$"))


def ner_entities(chunks: DataFrame, tagger: Callable[[], Callable[[list[str]], list[list[tuple[str, str, float]]]]], least: float = 0.7) -> DataFrame:
    """Spans of a caller's tagger (word, group, score) on texts cut to 2000 characters; ORG and PER of enough score."""

    @F.pandas_udf("array<struct<word:string,grp:string,score:double>>")
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = tagger()
        for p in parts:
            yield pd.Series([[{"word": w, "grp": g, "score": s} for w, g, s in spans] for spans in model(p.str.slice(0, 2000).tolist())])

    found = chunks.where(F.length("text") >= 10).select("source", F.explode(tag("text")).alias("e"))
    return found.select("source", F.col("e.word").alias("name"), F.when(F.col("e.grp") == "ORG", "companies").otherwise("people").alias("entity_type"), F.col("e.score").alias("confidence")).where((F.col("confidence") >= least) & F.col("e.grp").isin("ORG", "PER"))


def money_mentions(chunks: DataFrame) -> DataFrame:
    """Amounts with 50 characters around their own place."""
    return _spans(chunks, MONEY, 50).select("source", "name", "start", "context")


def clean_entity_name(name: Column) -> Column:
    """Without one leading article, cut at the first ending in list order that occurs, trimmed."""
    return _cut(_bare(name))


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^(the |a |an |by )", "")


def _cut(bare: Column) -> Column:
    low = F.lower(bare)
    cut = None
    for e in ENDINGS:
        here = F.substring(bare, F.lit(1), F.instr(low, e) - 1)
        cut = F.when(F.instr(low, e) > 0, here) if cut is None else cut.when(F.instr(low, e) > 0, here)
    return F.trim(cut.otherwise(bare))


def extract_relations(chunks: DataFrame, most_chunks: int | None = None) -> DataFrame:
    """Typed pairs around relation verbs: what stands before and after the last verb of a run of words without punctuation.

    Texts of under 50 characters are skipped; names are cleaned, unequal and longer than two characters.
    """
    rows = chunks if most_chunks is None else chunks.orderBy("source", "pos").limit(most_chunks)
    anywhere = "(?i)\\s(?:" + "|".join(RELATIONS.values()) + ")\\s"
    gated = rows.where((F.length(F.trim("text")) >= LEAST_RELATION_TEXT) & F.col("text").rlike(anywhere))
    runs = gated.select("source", F.posexplode(F.split("text", BETWEEN_RUNS, -1)).alias("sentence_no", "text")).where(F.col("text").rlike(anywhere))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(rf"(?is)^\s*(\S.*)\s+(?:{v})\s+(\S.*)$").alias("pattern")) for k, v in RELATIONS.items()])
    hits = runs.select("*", F.explode(F.filter(kinds, lambda k: F.rlike("text", k["pattern"]))).alias("k"))
    # steps of their own and a generator: what is used twice, or in a condition, is worked out once
    ends = hits.select("*", *[F.trim(F.expr(f"regexp_extract(text, k.pattern, {g})")).alias(f"__{g}") for g in (1, 2)])
    bare = ends.select("*", *[_bare(F.col(f"__{g}")).alias(f"__b{g}") for g in (1, 2)])
    named = bare.select("*", F.explode(F.array(F.struct(*[_cut(F.col(f"__b{g}")).alias(f"n{g}") for g in (1, 2)]))).alias("n"))
    found = named.select("source", "sentence_no", F.col("n.n1").alias("source_entity"), F.col("n.n2").alias("target_entity"), F.col("k.kind").alias("relationship_type"), F.substring("text", 1, 200).alias("context"))
    return found.where((F.lower("source_entity") != F.lower("target_entity")) & (F.length("source_entity") > 2) & (F.length("target_entity") > 2))


def dedup_relations(relations: DataFrame) -> DataFrame:
    """The first per lower-case pair and type, by source and sentence, on ties by the other columns.

    Every task keeps its own first, so a pair that stands in most texts is not gathered in one.
    """
    order = ["source", "sentence_no", *[c for c in relations.columns if c not in ("source", "sentence_no")]]
    best = relations.groupBy(F.lower("source_entity"), F.lower("target_entity"), "relationship_type").agg(F.min(F.struct(*order)).alias("first"))
    return best.select(*[F.col(f"first.{c}").alias(c) for c in relations.columns])


def name_duplicates(entities: DataFrame) -> DataFrame:
    """Groups of at least two distinct names of a type that are equal after crude normalisation."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^a-z0-9 ]", ""), r"\b(inc|llc|corp|corporation|ltd|limited|company|co)\b", ""))
    named = entities.select("entity_type", "name", norm.alias("norm")).distinct()
    return named.groupBy("entity_type", "norm").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names")).where("n > 1")
