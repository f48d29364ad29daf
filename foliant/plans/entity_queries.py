"""Queries on entities, legal terms, resolution, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import classify, entities, features, legal, resolve
from foliant.plans.corpora import corpus
from foliant.plans.registry import query
from foliant.plans.text_queries import SPANS

M1, M2 = entities.MONEY


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The legal corpus and the whole documents as chunks."""
    rows = corpus(spark, sf, "legal").select("store", "source", F.lit(0).alias("pos"), "text")
    other = corpus(spark, sf, "documents").select(F.col("source").alias("store"), F.concat(F.lit("note_"), "doc_id", F.lit(".txt")).alias("source"), F.lit(1).alias("pos"), "text")
    return rows.unionByName(other)


CHUNKS = "chunks as (select store, source, 0 as pos, text from legal union all select source, 'note_' || doc_id || '.txt', 1, text from documents)"


def spans(pattern: str, name: str) -> str:
    body = SPANS.format(key="source", text="text", p=pattern.replace("'", "''"), table="chunks").strip()
    return body.replace("s as (", f"s{name} as (").replace("from s)", f"from s{name})").replace("x as (", f"x{name} as (").replace("from x)", f"from x{name})").replace("spans as (", f"spans{name} as (")


# DuckDB's word boundary knows ASCII letters only. Where a match is ASCII throughout, other letters are looked at as
# underscores and other signs as a control character; a boundary at an end of a pattern is a character that is read.
MASKED = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{Nd}\p{Mn}]', chr(1), 'g'), '[^\x00-\x7F]', '_', 'g')"
NO_LETTER = r"[^\p{L}\p{Nd}\p{Mn}_]"


def word_spans(pattern: str, name: str) -> str:
    """SQL of the spans of a pattern whose matches are ASCII."""
    return spans(pattern, name).replace("regexp_extract_all(text,", f"regexp_extract_all({MASKED},").replace("string_split_regex(text,", f"string_split_regex({MASKED},")


def bounded(pattern: str) -> str:
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern.removeprefix(flag)
    body = f"(?:^|{NO_LETTER}){body[2:]}" if body.startswith(r"\b") else body
    return flag + (f"{body[:-2]}(?:{NO_LETTER}|$)" if body.endswith(r"\b") else body)


def first_hit(context: str, patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({context}, '{bounded(p)}', 1)), '')" for p in patterns) + ", null)"


CONTEXT = "substr(text, greatest(start - {n}, 0) + 1, (start + length(match) + {n} - greatest(start - {n}, 0))::bigint)"
COMPANIES = f"""{CHUNKS}, {word_spans(entities.CLOSING, "a")},
led as (select source, text, match, start, regexp_extract(substr(text, greatest(start - {entities.NAME_BEFORE}, 0) + 1, least(start, {entities.NAME_BEFORE})::bigint), '{entities.NAME_RUN}', 1) as lead from spansa),
whole as (select source, text, trim(lead || match) as name, (start - length(lead))::int as start, lead || match as match from led where lead <> ''),
comp as (select source, name, start, round(start / length(text), 6) as position, {CONTEXT.format(n=200)} as context from whole where length(name) between 5 and 80)"""


@query(f"with {COMPANIES} select source, name, start, position, context, " + ", ".join(f"{first_hit('context', p)} as {a}" for a, p in entities.ATTRIBUTES["company"].items()) + " from comp")
def extract_companies(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extract_companies(chunks(spark, sf))


P1, P2 = entities.PERSON
PEOPLE = f"""{CHUNKS}, {word_spans(P1, "e")}, {word_spans(P2, "f")}, found as (select * from spanse union all select * from spansf),
people as (select source, regexp_replace(match, '{entities.FORM}', '') as name, start, round(start / length(text), 6) as position, {CONTEXT.format(n=200)} as context from found),
parted as (select *, string_split_regex(name, '\\s+') as p from people)"""


@query(f"with {PEOPLE} select source, name, start, position, context, " + ", ".join(f"{first_hit('context', p)} as {a}" for a, p in entities.ATTRIBUTES["person"].items()) + ", p[1] as first_name, nullif(array_to_string(p[2:-2], ' '), '') as middle_name, p[-1] as last_name from parted")
def extract_people(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extract_people(chunks(spark, sf))


AMOUNT = f"""replace(regexp_extract(name, '({entities.NUMBER})', 1), ',', '')::double * coalesce(map_extract_value(map {{'thousand': 1e3, 'million': 1e6, 'billion': 1e9, 'k': 1e3, 'm': 1e6, 'b': 1e9}},
  lower(regexp_extract(name, '(?i){entities.NUMBER}\\s*(thousand|million|billion|k|m|b)\\b', 1))), 1.0)"""
MONEYS = f"""{CHUNKS}, {word_spans(M1, "c")}, {word_spans(M2, "d")}, money as (select * from spansc union all select * from spansd)"""


@query(f"""with {MONEYS}, f as (select source, match as name, start, round(start / length(text), 6) as position, {CONTEXT.format(n=100)} as context from money)
select source, name, start, position, context,
  {AMOUNT} as amount,
  coalesce({first_hit("context", entities.ATTRIBUTES["financial"]["currency"])}, 'USD') as currency, coalesce({first_hit("context", entities.ATTRIBUTES["financial"]["metric"])}, 'amount') as metric,
  coalesce({first_hit("context", entities.ATTRIBUTES["financial"]["period"])}, 'unspecified') as period from f""")
def extract_financials(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extract_financials(chunks(spark, sf))


@query(f"with {MONEYS} select source, match as name, start, {CONTEXT.format(n=50)} as context from money")
def money_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return entities.money_mentions(chunks(spark, sf))


LONG_CHUNKS = CHUNKS.replace("chunks as (", "chunks as (select * from (", 1) + " where length(trim(text, ' ')) >= 20)"
RICH = f"""{LONG_CHUNKS}{(COMPANIES + ", " + PEOPLE + ", " + MONEYS).replace(CHUNKS, "").replace(", ,", ",")},
rich as (select 'companies' as entity_type, name, source, start, context, 0.85::double as confidence from comp
  union all select 'people', name, source, start, context, 0.8 from people
  union all select 'financial_metrics', match, source, start, {CONTEXT.format(n=100)}, 0.9 from money)"""


@query(f"with {RICH} select *, 'rich_pattern' as extraction_method from rich")
def extract_rich_entities(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extract_rich_entities(chunks(spark, sf))


@query(f"with {COMPANIES} select substr(sha256(concat_ws('|', source, name, start)), 1, 16) as unique_id, lower(name) as company_name, " + ", ".join(f"{first_hit('context', entities.ATTRIBUTES['company'][a])} as {a}" for a in ("jurisdiction", "legal_form", "role")) + ", source from comp")
def to_linkage_columns(spark: SparkSession, sf: str) -> DataFrame:
    return entities.to_linkage_columns(entities.extract_companies(chunks(spark, sf)))


@query(f"with {PEOPLE} select substr(sha256(concat_ws('|', source, name, start)), 1, 16) as unique_id, lower(name) as full_name, p[1] as first_name, nullif(array_to_string(p[2:-2], ' '), '') as middle_name, p[-1] as last_name, " + ", ".join(f"{first_hit('context', p)} as {a}" for a, p in entities.ATTRIBUTES["person"].items()) + ", length(name)::int as name_length, source from parted")
def people_linkage_columns(spark: SparkSession, sf: str) -> DataFrame:
    return entities.people_linkage_columns(entities.extract_people(chunks(spark, sf)))


@query(f"""with {MONEYS}, f as (select source, match as name, start, round(start / length(text), 6) as position, {CONTEXT.format(n=100)} as context from money)
select substr(sha256(concat_ws('|', source, name, start)), 1, 16) as unique_id, name as amount_text, {AMOUNT} as normalized_amount,
  coalesce({first_hit("context", entities.ATTRIBUTES["financial"]["currency"])}, 'USD') as currency, coalesce({first_hit("context", entities.ATTRIBUTES["financial"]["metric"])}, 'amount') as metric_type,
  coalesce({first_hit("context", entities.ATTRIBUTES["financial"]["period"])}, 'unspecified') as period, position, source from f""")
def financial_linkage_columns(spark: SparkSession, sf: str) -> DataFrame:
    return entities.financial_linkage_columns(entities.extract_financials(chunks(spark, sf)))


@query(f"""with {CHUNKS}, t as (select source, string_agg(text, ' ' order by pos) as t from chunks group by source)
select t.source, split_part(t.source, '_', 1) as name, """ + ", ".join(f"{first_hit('t', p)} as {a}" for a, p in entities.ATTRIBUTES["company"].items()) + " from t")
def enrich_entities(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    named = c.select("source", F.split_part("source", F.lit("_"), F.lit(1)).alias("name")).distinct()
    return entities.enrich_entities(named, c)


@query(f"with {CHUNKS} select trim(replace(replace(source, '.txt', ''), '_', ' ')) as name, source, substr(arg_min(text, pos), 1, 200) as context, 1.0::double as confidence from chunks group by source")
def document_entities(spark: SparkSession, sf: str) -> DataFrame:
    return entities.document_entities(chunks(spark, sf))


@query("""with n as (select c_name as name from customer union all select s_name from supplier union all select p_name from part union all select unnest(string_split(text, chr(10))) from documents)
select name, length(name) >= 3 and regexp_matches(name, '[A-Z]') and not regexp_matches(name, '^\\d') and lower(name) not in ('agreement', 'company', 'the company', 'party') as company,
  len(string_split_regex(trim(name), '\\s+')) between 2 and 4 and len(list_filter(string_split_regex(trim(name), '\\s+'), lambda p: not regexp_matches(p, '^[A-Z][a-z]*\\.?$'))) = 0 as person from n""")
def valid_names(spark: SparkSession, sf: str) -> DataFrame:
    """Given names, and every line of every text."""
    n = corpus(spark, sf, "customer").select(F.col("c_name").alias("name")).union(corpus(spark, sf, "supplier").select("s_name")).union(corpus(spark, sf, "part").select("p_name"))
    lines = corpus(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)))
    return n.union(lines).select("name", entities.valid_company(F.col("name")).alias("company"), entities.valid_person(F.col("name")).alias("person"))


@query(f"""with {CHUNKS}, w as (select source, unnest(list_distinct(regexp_extract_all(substr(text, 1, 2000), '[A-Z][a-z]{{5,}}'))) as word from chunks where length(text) >= 10),
g as (select source, word as name, case when length(word) % 2 = 0 then 'companies' else 'people' end as entity_type, round(least(length(word), 10) / 10.0, 6)::double as confidence from w)
select * from g where confidence >= 0.7""")
def ner_entities(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's tagger: capitalised words, by their length."""

    def tagger():
        import re

        def tag(texts: list[str]) -> list[list[tuple[str, str, float]]]:
            found = [dict.fromkeys(re.findall("[A-Z][a-z]{5,}", t)) for t in texts]
            return [[(w, "PER" if len(w) % 2 else "ORG", min(len(w), 10) / 10) for w in ws] for ws in found]

        return tag

    return entities.ner_entities(chunks(spark, sf), tagger)


ANY_VERB = "(?i)\\s(?:" + "|".join(entities.RELATIONS.values()) + ")\\s"


def cleaned(group: int) -> str:
    """SQL of a cleaned entity name."""
    bare = f"regexp_replace(trim(regexp_extract(text, p{group}, {group})), '(?i)^(the |a |an |by )', '')"
    cut = " ".join(f"when instr(lower({bare}), '{e}') > 0 then substr({bare}, 1, instr(lower({bare}), '{e}') - 1)" for e in entities.ENDINGS)
    return f"trim(case {cut} else {bare} end)"


def relations() -> str:
    """SQL of all relations; DuckDB wants constant patterns."""
    parts = []
    for kind, verbs in entities.RELATIONS.items():
        pattern = f"'(?is)^\\s*(\\S.*)\\s+(?:{verbs})\\s+(\\S.*)$'"
        one, two = (cleaned(g).replace(f"p{g}", pattern) for g in (1, 2))
        parts.append(f"select source, sentence_no, {one} as source_entity, {two} as target_entity, '{kind}' as relationship_type, substr(text, 1, 200) as context from runs where regexp_matches(text, {pattern})")
    return f"""{CHUNKS}, cut as (select source, string_split_regex(text, '{entities.BETWEEN_RUNS}') as w from chunks where length(trim(text)) >= 50 and regexp_matches(text, '{ANY_VERB}')),
placed as (select source, w, unnest(range(0, len(w))) as i from cut),
runs as (select source, i::int as sentence_no, w[i + 1] as text from placed where regexp_matches(w[i + 1], '{ANY_VERB}')),
every as ({" union all ".join(parts)}),
relations as (select * from every where lower(source_entity) <> lower(target_entity) and length(source_entity) > 2 and length(target_entity) > 2)"""


@query(f"with {relations()} select * from relations")
def extract_relations(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extract_relations(chunks(spark, sf))


@query(f"with {relations()}, r as (select *, row_number() over (partition by lower(source_entity), lower(target_entity), relationship_type order by source, sentence_no) as n from relations) select source, lower(source_entity) as a, lower(target_entity) as b, relationship_type from r where n = 1")
def dedup_relations(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.dedup_relations(entities.extract_relations(chunks(spark, sf)))
    return found.select("source", F.lower("source_entity").alias("a"), F.lower("target_entity").alias("b"), "relationship_type")


@query("""with n as (select distinct regexp_extract(text, 'between (.*?), a Delaware', 1) as name from legal),
m as (select name, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), '\\b(inc|llc|corp|corporation|ltd|limited|company|co)\\b', '', 'g')) as norm from n)
select 'companies' as entity_type, norm, count(*) as n, string_agg(name, '; ' order by name) as names from m group by norm having count(*) > 1""")
def name_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return entities.name_duplicates(company_names(spark, sf))


def company_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.regexp_extract("text", "between (.*?), a Delaware", 1)
    return corpus(spark, sf, "legal").select(F.lit("companies").alias("entity_type"), name.alias("name"), "source", "store")


# legal terms


def quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def stands(number: int, end: str, verbs: str) -> str:
    """SQL of a term right before a verb, with its meaning behind it."""
    e, m = quote(end), quote(legal.MEANING)
    return f"""select source, start, {number} as pattern_idx, regexp_extract(before, {e}, 1) as term, regexp_extract(behind, {m}, 1) as canonical, regexp_extract(before, {e}) || match || regexp_extract(behind, {m}) as context
from said where {verbs} and regexp_matches(before, {e}) and regexp_extract(behind, {m}, 1) <> ''"""


DEFINITIONS = f"""{CHUNKS}, {spans(legal.ANCHOR, "k")},
around as (select source, match, start, substr(text, greatest(start - {legal.BEFORE}, 0) + 1, least(start, {legal.BEFORE})::bigint) as before, substr(text, start + length(match) + 1, {legal.BEHIND}) as behind from spansk),
parts as (select *, list_filter(string_split_regex(before, '[,"()]+'), lambda p: trim(p) <> '') as ps, string_split_regex(before, '["(]')[-1] as tail, regexp_extract(match, '"([^"]+)"', 1) as quoted,
  regexp_replace(lower(match), '\\s+', ' ', 'g') as verb from around),
lasts as (select *, trim(case when regexp_matches(coalesce(ps[-1], ''), '^\\s*an? ') then coalesce(ps[-2], ps[-1]) else coalesce(ps[-1], '') end) as part from parts),
named as (select *, coalesce(nullif(trim(regexp_extract(part, '(?:^| )((?:[A-Z][A-Za-z0-9_&]* ?)+)$', 1)), ''), part) as who, match[1] = '(' and contains(match, '"') as bracket, match[1] = '(' and not contains(match, '"') as section, match[1] = ',' as firm, starts_with(match, 'between') as party from lasts),
said as (select *, regexp_matches(verb, '^(shall )?means?$') as means, regexp_matches(verb, '^refers? to$') as refers, regexp_matches(verb, '^includes?$') as includes from named where not (bracket or section or firm or party)),
every as (
select source, start, case when starts_with(match, '(the') then 1 else 0 end as pattern_idx, quoted as term, who as canonical, tail || match as context from named where bracket
union all {stands(2, legal.QUOTED_END, "true")} union all {stands(3, legal.TITLE_END, "means")} union all {stands(4, legal.TITLE_END, "(refers or includes)")}
union all {stands(5, legal.INTRODUCED_END, "(means or refers)").replace(", 1) as term", ", 1) as term")} union all {stands(10, legal.CAPITALS_END, "(means or refers or includes)")}
union all select source, start, 6, regexp_extract(match, '({legal.NAME}\\s+\\w+)$', 1), who, tail || match from named where firm
union all select source, start, 7, quoted, regexp_extract(before, '{legal.DOCUMENT_END}', 1), regexp_extract(before, '{legal.DOCUMENT_END}') || match from named where bracket and regexp_matches(before, '{legal.DOCUMENT_END}')
union all select source, start, 8, regexp_extract(match, 'between\\s+({legal.NAME})', 1), regexp_extract(match, 'between\\s+({legal.NAME})', 1), match from named where party
union all select source, start, 9, regexp_extract(before, '{legal.TITLE_END}', 1), regexp_extract(before, '{legal.TITLE_END}', 1), regexp_extract(before, '{legal.TITLE_END}') || match from named where section and regexp_extract(before, '{legal.TITLE_END}', 1) <> ''),
cleaned as (select source, start, pattern_idx, lower(trim(term)) as keyword, regexp_replace(trim(regexp_replace(canonical, '\\s+', ' ', 'g')), '[.,;:]+$', '') as canonical_name, context, lower(regexp_replace(context, '\\s+', ' ', 'g')) as low from every),
sure as (select *, round(least(1.0, [{", ".join(str(b) for _, b in legal.KINDS)}][pattern_idx + 1] + case when length(context) > {legal.LONG} then {legal.TOO_LONG} else 0 end
  + {" + ".join(f"case when contains(low, '{p}') then {v} else 0 end" for p, v in legal.PHRASES)} + case when regexp_matches(low, 'this \\w+ ?\\(') then {legal.THIS_BRACKET} else 0 end
  + case when regexp_matches(low, 'a \\w+ corporation') then {legal.A_CORPORATION} else 0 end + case when list_has_any(string_split_regex(low, '\\W+'), {list(legal.CONNECTIVES)}) then {legal.CONNECTED} else 0 end), 6)::double as confidence
  from cleaned where length(keyword) > 1 and length(canonical_name) > 2 and keyword not in {legal.NOISE}),
defined as (select source, keyword, canonical_name, case when keyword in {legal.ENTITY_TERMS} then 'entity' when keyword in {legal.DOCUMENT_TERMS} then 'document' else 'other' end as keyword_type, context, confidence, pattern_idx::int as pattern_idx,
  {[name for name, _ in legal.KINDS]}[pattern_idx + 1] as pattern_type, start, row_number() over (partition by source, keyword order by confidence desc, pattern_idx, start) as r from sure)"""


@query(f"with {DEFINITIONS} select * exclude (r) from defined where r = 1")
def extract_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return legal.extract_definitions(chunks(spark, sf))


@query(f"with {DEFINITIONS} select source, keyword, pattern_idx, pattern_type, confidence, start from defined")
def all_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Every definition before the best of each term is chosen."""
    return legal.all_definitions(chunks(spark, sf)).select("source", "keyword", "pattern_idx", "pattern_type", "confidence", "start")


@query(f"with {DEFINITIONS} select source, keyword, keyword_type from defined where r = 1")
def classify_keywords(spark: SparkSession, sf: str) -> DataFrame:
    found = legal.extract_definitions(chunks(spark, sf))
    return found.select("source", "keyword", "keyword_type")


@query(f"with {DEFINITIONS} select source, count(*) as n_terms, max(confidence) as surest, arg_max(keyword, (confidence, keyword)) as keyword from defined where r = 1 group by source")
def best_definition(spark: SparkSession, sf: str) -> DataFrame:
    """Per source the number of defined terms and the surest of them."""
    found = legal.extract_definitions(chunks(spark, sf))
    return found.groupBy("source").agg(F.count("*").alias("n_terms"), F.max("confidence").alias("surest"), F.max_by("keyword", F.struct("confidence", "keyword")).alias("keyword"))


@query(f"with {CHUNKS} select source, string_agg(text, ' ' order by pos) as text from chunks group by source")
def document_text(spark: SparkSession, sf: str) -> DataFrame:
    return legal.document_text(chunks(spark, sf))


@query("""select source, regexp_replace(text, '(?i)\\bcompany\\b', 'ACME $ Corp', 'g') as text, true as replaced from legal""")
def replace_keywords(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf, "legal").select("source", "text")
    defs = c.select("source", F.lit("Company").alias("keyword"), F.lit("ACME $ Corp").alias("canonical_name"), F.lit("entity").alias("keyword_type"))
    return legal.replace_keywords(c, defs)


@query()
def process_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return legal.process_chunks(chunks(spark, sf))


@query(f"""with {DEFINITIONS}, best as (select * from defined where r = 1)
select 'entity' as kind, source, upper(keyword) as name, canonical_name as other, 'legal_keywords' as type, confidence from best
union all select 'relation', source, upper(keyword), source, 'defined_in', confidence from best union all select 'relation', source, upper(keyword), canonical_name, 'refers_to', confidence from best where keyword_type = 'entity'""")
def keyword_entities_and_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Each term as an entity, that it is defined in its source, and the parties that those of the entity kind refer to."""
    return legal.keyword_entities_and_relations(legal.extract_definitions(chunks(spark, sf)))


# resolution


@query("""select source, regexp_replace(lower(trim(regexp_extract(text, 'between (.*?), a Delaware', 1))), ',?\\s+(incorporated|inc|llc|corporation|corp|limited|ltd|company|co)\\.?$', '') as norm from legal""")
def normalise_entity_name(spark: SparkSession, sf: str) -> DataFrame:
    return company_names(spark, sf).select("source", resolve.normalise_entity_name(F.col("entity_type"), F.col("name")).alias("norm"))


@query("""select source, regexp_extract(text, 'between (.*?), a Delaware', 1) || ' ' || substr(text, 1, case when store in ('room-0', 'room-1') then 150 else 50 end) as entity_text from legal""")
def entity_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf, "legal")
    weight = F.when(F.col("store").isin("room-0", "room-1"), 0.7).otherwise(0.3)
    return rows.select("source", resolve.entity_text(F.regexp_extract("text", "between (.*?), a Delaware", 1), F.col("text"), weight).alias("entity_text"))


def vector_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors and slightly moved copies as entities: id, entity_type, name, source, context, confidence, vec."""
    given = corpus(spark, sf, "embeddings")
    beyond = given.agg((F.max("vec_id") + 1).alias("beyond"))  # one row
    e = given.select(F.col("vec_id").alias("id"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    near = e.crossJoin(F.broadcast(beyond)).select((F.col("vec_id") + F.col("beyond")).alias("id"), "vec_id", F.transform("vec", lambda x, i: x + F.when(i == 0, 0.05).otherwise(0.0)).alias("vec"), "label")
    kind = F.element_at(F.array(*map(F.lit, ("companies", "people"))), (F.col("label") % 2 + 1).cast("int"))
    rows = e.unionByName(near)
    return rows.select("id", kind.alias("entity_type"), F.concat(F.lit("Entity "), "vec_id").alias("name"), F.concat(F.lit("doc_"), F.col("id") % 97, F.lit(".txt")).alias("source"), F.concat(F.lit("context "), "vec_id").alias("context"), ((F.col("id") % 5) / 5).alias("confidence"), F.lit("rich_pattern").alias("extraction_method"), "vec")


ENTITIES = """
e as (select vec_id as id, embedding::double[] as v, label from embeddings union all select vec_id + (select max(vec_id) + 1 from embeddings), list_transform(embedding::double[], lambda x, i: x + case when i = 1 then 0.05 else 0 end), label from embeddings),
en as (select id, case when label % 2 = 0 then 'companies' else 'people' end as entity_type, v, case when label % 2 = 0 then 0.8 else 0.85 end as t from e)
"""


def pairs_of(rows: DataFrame) -> DataFrame:
    return resolve.similar_pairs(rows, ["entity_type"], resolve.threshold_of(F.col("entity_type")))


@query(f"with {ENTITIES} select a.id as a, b.id as b, round(list_cosine_similarity(a.v, b.v), 6) as score from en a join en b on a.entity_type = b.entity_type and a.id < b.id where round(list_cosine_similarity(a.v, b.v), 6) >= a.t")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs_of(vector_entities(spark, sf))


# components of the pairs by their smallest row; inside each, as long as two clusters have a mean distance below the limit,
# the nearest two become one (ties: smallest first row, then second), their distances weighed by their numbers of rows
CLUSTERS = f"""{ENTITIES}, pairs as materialized (select a.id as a, b.id as b from en a join en b on a.entity_type = b.entity_type and a.id < b.id where round(list_cosine_similarity(a.v, b.v), 6) >= a.t),
links as materialized (select a, b from pairs union all select b, a from pairs),
reached(id, c) as (select a, least(a, min(b)) from links group by a union select b, min(c) from reached join links on a = id where c < b group by b),
parts as materialized (select id, min(c) as c from reached group by id),
rows_of as materialized (select c, id, v, t from parts join en using (id)),
apart as materialized (select x.c, x.id as a, y.id as b, round(1 - list_cosine_similarity(x.v, y.v), 9) as d, 1.0::double - x.t::double as lim from rows_of x join rows_of y on x.c = y.c and x.id < y.id),
linked(step, c, a, b, d, na, nb, lim, i, j) as (
  select 0, c, a, b, d, 1.0::double, 1.0::double, lim, arg_min(a, (d, a, b)) over w, arg_min(b, (d, a, b)) over w from apart window w as (partition by c)
  union all
  select step, c, a, b, d, na, nb, lim, arg_min(a, (d, a, b)) over w, arg_min(b, (d, a, b)) over w from (
    select step + 1 as step, c, least(x, y) as a, greatest(x, y) as b, sum(d * w) / sum(w) as d, sum(case when x < y then nx else ny end) / count(*) as na, sum(case when x < y then ny else nx end) / count(*) as nb, lim from (
      select step, c, d, lim, case when a = j then i else a end as x, case when b = j then i else b end as y, case when a in (i, j) then na when b in (i, j) then nb else 1.0 end as w,
        case when a in (i, j) then ni + nj else na end as nx, case when b in (i, j) then ni + nj else nb end as ny
      from (select *, max(case when a = i and b = j then na end) over (partition by c) as ni, max(case when a = i and b = j then nb end) over (partition by c) as nj, min(d) over (partition by c) as least_d from linked)
      where least_d < lim and not (a = i and b = j))
    group by step, c, least(x, y), greatest(x, y), lim) window w as (partition by c)),
merges as materialized (select distinct step, c, i, j from linked where a = i and b = j and d < lim),
clustered(id, cluster) as (select id, id from en union all select id, i from clustered join merges on j = cluster),
clusters as materialized (select id, min(cluster) as cluster from clustered group by id)"""


def clusters_of(rows: DataFrame) -> DataFrame:
    limit = resolve.threshold_of(F.col("entity_type"))
    return resolve.cluster_entities(rows, resolve.similar_links(rows, ["entity_type"], limit), limit)


@query(f"with recursive {CLUSTERS} select id, cluster from clusters")
def cluster_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and their moved copies in clusters of the same type."""
    return clusters_of(vector_entities(spark, sf))


MERGED = f"""{CLUSTERS}, named as (select id, entity_type, id % (select max(vec_id) + 1 from embeddings) as vec_id from en),
r as (select id, cluster, entity_type, 'Entity ' || vec_id as name, 'doc_' || id % 97 || '.txt' as source, (id % 5) / 5.0::double as confidence, 'context ' || vec_id as context from named join clusters using (id)"""
# every name has a capital and more than three characters, and every row the richer method
SCORE = "round(0.4::double * confidence + 0.3::double * least(length(context) / 200, 1.0::double) + 0.2::double + 0.1::double, 6)"


@query(f"""with recursive {MERGED})
select entity_type, cluster, arg_max(name, ({SCORE}, id)) as name, array_to_string(list_sort(list(distinct source)), '; ') as sources, count(*) as cluster_size, round(avg(nullif(confidence, 0.0)), 6) as confidence, array_to_string(list_sort(list(distinct context))[1:3], ' | ') as contexts from r group by entity_type, cluster""")
def merge_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_entities(spark, sf)
    return resolve.merge_clusters(rows, clusters_of(rows))


@query(f"""with recursive {MERGED}
  union all select -1, -1, 'documents', 'Only one', 'one.txt', 0.5, 'its context' union all select -2, -2, 'legal_keywords', 'No vector', 'two.txt', 0.0, null)
select entity_type, cluster, coalesce(arg_max(name, ({SCORE}, id)), min(name)) as name, array_to_string(list_sort(list(distinct source)), '; ') as sources, count(*) as cluster_size, round(avg(nullif(confidence, 0.0)), 6) as confidence,
  coalesce(array_to_string(list_sort(list(distinct context) filter (context is not null))[1:3], ' | '), '') as contexts from r group by entity_type, cluster""")
def resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All types in one job; a type of one row and a row without a vector pass."""
    rows = vector_entities(spark, sf)
    single = spark.createDataFrame([(-1, "documents", "Only one", "one.txt", "its context", 0.5, "ner", [1.0] * 64), (-2, "legal_keywords", "No vector", "two.txt", None, 0.0, "ner", None)], rows.schema)
    return resolve.resolve_entities(rows.unionByName(single))


@query(f"""with recursive {CLUSTERS}, n as (select entity_type, count(*) as n_before, count(distinct cluster) as n_after from en join clusters using (id) group by entity_type)
select coalesce(entity_type, 'total') as entity_type, sum(n_before)::bigint as n_before, sum(n_after)::bigint as n_after, sum(n_before - n_after)::bigint as removed, round(100.0 * sum(n_before - n_after) / sum(n_before), 2)::double as percent from n group by rollup (entity_type)""")
def resolution_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_entities(spark, sf)
    return resolve.resolution_stats(rows, resolve.merge_clusters(rows, clusters_of(rows)))


# classification


@query(f"with {CHUNKS} select source, substr(text, 1, 800) as text from chunks")
def first_chunk_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return classify.first_chunk_inputs(chunks(spark, sf).withColumn("is_first_chunk", F.lit(True)))


@query("""with e as (select vec_id, label, embedding::double[] as v from embeddings),
c as (select label, list(x order by i) as c from (select label, i, avg(v[i]) as x from (select label, v, unnest(range(1, 65)) as i from e where vec_id % 2 = 0) group by label, i) group by label),
s as (select vec_id, c.label as predicted, round(list_cosine_similarity(v, c.c), 6) as score from e, c)
select vec_id, predicted, score from (select *, row_number() over (partition by vec_id order by score desc, predicted) as r from s) where r = 1""")
def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus(spark, sf, "embeddings")
    return classify.nearest_centroid(e, e.where("vec_id % 2 = 0"), "vec_id", "embedding", "label")


@query()
def classify_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels by naive Bayes, learned from two thirds of the labelled documents; the tests re-compute it."""
    docs, labels = corpus(spark, sf, "documents"), corpus(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = labels.where("quality is not null").select("doc_id", "quality").where(~held)
    model = features.fit_text_classifier(docs.join(known.hint("merge"), "doc_id"), label="quality")
    return features.classify_texts(docs, model, "doc_id").select("doc_id", held.alias("held_out"), "predicted", "probability")


@query("select doc_id, case when length(text) > 1000 then 'long' else 'short' end as predicted from documents")
def classify_with(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's classifier, made once per worker."""

    def by_length():
        return lambda texts: [" The document type is " + ("Long" if len(t) > 1000 else "Short") for t in texts]

    return classify.classify_with(corpus(spark, sf, "documents"), "doc_id", "text", by_length)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def skip_classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify.skip_classified(corpus(spark, sf, "documents").select("doc_id"), corpus(spark, sf, "labels"), "doc_id")


@query("select vec_id, 'type ' || label as label from embeddings")
def clean_type_label(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "embeddings").select("vec_id", classify.clean_type_label(F.concat(F.lit(" The document type is Type "), "label")).alias("label"))


@query("select count(*) as n_docs, count(l.doc_id) as n_classified, round(count(l.doc_id) / count(*), 6) as rate from documents d left join (select distinct doc_id from labels where quality = 1) l using (doc_id)")
def classification_rate(spark: SparkSession, sf: str) -> DataFrame:
    types = corpus(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("not classified").alias("type"))
    return classify.classification_rate(corpus(spark, sf, "documents"), types, "doc_id", "type")


@query("""with l as (select conv_id, arg_max(lower(text), turn) as t from messages group by conv_id)
select conv_id, case when contains(t, 'parse') then 'parse' when contains(t, 'match') then 'match' when contains(t, '?') then 'answer' else 'summarize' end as action from l""")
def route_messages(spark: SparkSession, sf: str) -> DataFrame:
    return classify.route_messages(corpus(spark, sf, "messages"))


@query("""with a as (select *, row_number() over (partition by conv_id order by (length(text) >= 200) desc, turn desc) as r from messages where role = 'assistant') select conv_id, turn, text from a where r = 1""")
def select_final_message(spark: SparkSession, sf: str) -> DataFrame:
    return classify.select_final_message(corpus(spark, sf, "messages"))


