"""Queries on chunking, text preparation, sources and sparse search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.shared import scratch_dir
from foliant.operators import sparse, text
from foliant.plans.corpora import corpus
from foliant.plans.registry import query
from foliant.sources import files as rooms
from foliant.streaming.index import SparseIndex, updated_index
from foliant.streaming.ingest import ingest_and_read

CHUNKS = """
chunks as (select doc_id, source, pos, substr(text, 1 + 800 * pos, 1000) as chunk from
  (select doc_id, source, text, unnest(range(0, greatest(1, length(text) - 200), 800)) // 800 as pos from documents))
"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return text.chunk_fixed(corpus(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")


@query(f"with {CHUNKS} select doc_id, source, pos::int as pos, chunk from chunks")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf)


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return text.chunk_recursive(corpus(spark, sf, "documents"), "doc_id")


@query()
def chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    """The recursive splitter as a table function in a lateral join; the tests re-compute it."""
    return text.chunks_of(corpus(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "pos", "chunk")


@query(f"with {CHUNKS} select count(*) as chunks, count(*) filter (pos = 0) as first_chunks, sum(length(chunk))::bigint as n_chars, count(*) filter (length(chunk) = 0) as empty from chunks")
def written_with_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Figures observed while the chunks are written."""
    seen = text.written_with_stats(_chunks(spark, sf), scratch_dir(spark, "chunks"))
    return spark.createDataFrame([[seen[c] for c in ("chunks", "first_chunks", "n_chars", "empty")]], "chunks long, first_chunks long, n_chars long, empty long")


@query(f"with {CHUNKS} select doc_id, pos::int as pos, 'chunk_' || (row_number() over (order by doc_id, pos) - 1) as chunk_id from chunks")
def number_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return text.number_chunks(_chunks(spark, sf).select("doc_id", "pos"), ["doc_id", "pos"])


@query(f"with {CHUNKS} select doc_id, source, pos::int as pos, 'chunk_' || (row_number() over (partition by source order by doc_id, pos) - 1) as chunk_id from chunks")
def number_chunks_per_store(spark: SparkSession, sf: str) -> DataFrame:
    return text.number_chunks(_chunks(spark, sf).select("doc_id", "source", "pos"), ["doc_id", "pos"], "source")


@query(f"with {CHUNKS} select doc_id, pos::int as pos, pos = 0 as is_first_chunk from chunks")
def mark_first_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return text.mark_first_chunk(_chunks(spark, sf).select("doc_id", "pos"), "doc_id")


@query("select page_id, coalesce('page ' || case when page_id % 3 = 0 then page_id end, case when page_id % 3 = 1 then url end, 'document') as citation from pages")
def citation_label(spark: SparkSession, sf: str) -> DataFrame:
    page, name = F.when(F.col("page_id") % 3 == 0, F.col("page_id")), F.when(F.col("page_id") % 3 == 1, F.col("url"))
    return corpus(spark, sf, "pages").select("page_id", text.citation_label(page, name).alias("citation"))


@query(f"with {CHUNKS} select source, count(distinct doc_id) as documents, count(*) as chunks, count(*) filter (pos = 0) as first_chunks from chunks group by source")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return text.chunk_stats(_chunks(spark, sf))


@query(f"select doc_id, trim(translate(translate(lower(text), '{text._ACCENTS[0]}', '{text._ACCENTS[1]}'), '{text._MARKS[0]}', '{text._MARKS[1].replace(chr(39), chr(39) * 2)}'), ' ') as key from documents")
def normalise_key(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "documents").select("doc_id", text.normalise_key(F.col("text")).alias("key"))


@query("select doc_id, replace(replace(replace(replace(replace(text, '$', '\\$'), '\\(', '\\\\('), '\\)', '\\\\)'), '\\[', '\\\\['), '\\]', '\\\\]') as escaped from documents")
def escape_markdown_math(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "documents").select("doc_id", text.escape_markdown_math(F.col("text")).alias("escaped"))


@query("select doc_id, substr(sha256(text), 1, 16) as text_hash, sha256(text) as file_hash from documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("text_hash"), F.sha2("text", 256).alias("file_hash"))


@query("select doc_id, length(text) // 4 as tokens, length(text) // 4 <= 1000 as within_limit from documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    n = text.token_estimate(F.col("text"))
    return corpus(spark, sf, "documents").select("doc_id", n.alias("tokens"), (n <= 1000).alias("within_limit"))


@query("select doc_id, case when length(text) > 300 then substr(text, 1, 300) || '...' else text end as short from documents")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "documents").select("doc_id", text.truncate_text(F.col("text"), 300).alias("short"))


SPANS = """
s as (select {key}, {text} as text, regexp_extract_all({text}, '{p}') as m, string_split_regex({text}, '{p}') as g from {table}),
x as (select {key}, text, m, g, unnest(range(1, len(m) + 1)) as i from s),
spans as (select {key}, text, m[i] as match, (list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0))::int as start from x)
"""


@query("with " + SPANS.format(key="doc_id", text="text", p="[A-Z][a-z]+ [A-Z][a-z]+", table="documents") + " select doc_id, match, start, (start + length(match))::int as \"end\" from spans")
def regex_spans(spark: SparkSession, sf: str) -> DataFrame:
    return text.regex_spans(corpus(spark, sf, "documents").select("doc_id", "text"), "text", "[A-Z][a-z]+ [A-Z][a-z]+").drop("text")


@query("with " + SPANS.format(key="source", text="text", p="[$][0-9]+ million", table="legal") + " select source, match, substr(text, greatest(start - 30, 0) + 1, start + length(match) + 30 - greatest(start - 30, 0)) as context from spans")
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    spans = text.regex_spans(corpus(spark, sf, "legal").select("source", "text"), "text", "[$][0-9]+ million")
    return spans.select("source", "match", text.context_window(F.col("text"), F.col("start"), F.col("end"), 30).alias("context"))


@query("""
with a as (select doc_id, text, instr(lower(text), 'the that') as p from documents),
b as (select *, greatest(p - 101, 0) as f, least(p - 1 + 300, length(text)) as l from a)
select doc_id, case when p > 0 then case when f > 0 then '...' else '' end || substr(text, f + 1, l - f) || case when l < length(text) then '...' else '' end else substr(text, 1, 400) end as excerpt from b""")
def best_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf, "documents")
    return docs.select("doc_id", text.best_excerpt(F.col("text"), F.lit("The that")).alias("excerpt"))


@query("""
with a as (select source, text, instr(lower(text), 'holdings') as h, case when instr(lower(text), 'ebitda') > 0 then instr(lower(text), 'ebitda') else instr(lower(text), 'revenue') end as k from legal),
b as (select *, least(h, k) - 1 as mid from a)
select source, case when h > 0 and k > 0 then substr(text, greatest(mid - 100, 0) + 1, mid + 350 - greatest(mid - 100, 0)) end as excerpt from b""")
def keyword_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "legal").select("source", text.keyword_excerpt(F.col("text"), F.lit("Holdings"), ["ebitda", "revenue"]).alias("excerpt"))


# sources


@query("select path, name, size, format('{:,}', size) as size_text from files where ext in ('.pdf', '.docx', '.txt', '.md')")
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return rooms.file_inventory(corpus(spark, sf, "files"))


@query("select project, room, count(*) as n_files, lower(replace(room, ' ', '-')) as slug from files where ext <> '.xyz' group by project, room")
def discover_stores(spark: SparkSession, sf: str) -> DataFrame:
    return rooms.discover_stores(corpus(spark, sf, "files"))


@query("select count(*) filter (ext <> '.xyz') as documents, count(*) filter (ext = '.xyz') as unsupported, count(distinct project) as projects, count(distinct (project, room)) as rooms from files")
def count_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return rooms.count_by_type(corpus(spark, sf, "files"))


@query("select distinct project, room from files f where exists (select 1 from files g where g.project = f.project and g.room = f.room and g.ext <> '.xyz')")
def has_supported_files(spark: SparkSession, sf: str) -> DataFrame:
    f = corpus(spark, sf, "files")
    return rooms.has_supported_files(f.select("project", "room").distinct(), f)


@query("select distinct room from files where room not in (select room from files where name like '%7.md')")
def missing_index(spark: SparkSession, sf: str) -> DataFrame:
    f = corpus(spark, sf, "files")
    return rooms.missing_index(f.select("room").distinct(), f.where("name like '%7.md'"))


@query("select project, count(distinct room) as n_rooms, count(*)::bigint as n_documents from files where ext <> '.xyz' group by project")
def project_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return rooms.project_catalog(corpus(spark, sf, "files"))


@query("select name, case when length(text) > 500 then substr(text, 1, 500) || '...' else text end as text from files")
def chunks_from_store(spark: SparkSession, sf: str) -> DataFrame:
    return rooms.chunks_from_store(corpus(spark, sf, "files").select("name", "text"))


@query("""select name, case ext when '.pdf' then 'application/pdf' when '.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  when '.txt' then 'text/plain' when '.md' then 'text/markdown' else 'application/octet-stream' end as mime, 'Doc ' || split_part(split_part(name, '.', 1), '_', 2) as title from files""")
def mime_and_title(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "files").select("name", rooms.mime_type(F.col("name")).alias("mime"), rooms.document_title(F.col("name")).alias("title"))


@query("select room as store, count(*) as n from files group by room")
def save_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "store")
    rows = corpus(spark, sf, "files").select("name", F.col("room").alias("store"))
    rooms.save_store(rows.where("store < 'src5'"), path)
    rooms.save_store(rows.where("store >= 'src5'"), path)
    return spark.read.parquet(path).groupBy(F.col("store").cast("string").alias("store")).agg(F.count("*").alias("n"))


@query("select name, text from files where room = 'src3'")
def read_prebuilt(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "prebuilt")
    corpus(spark, sf, "files").select(F.col("room").alias("file"), "name", "text").write.partitionBy("file").parquet(path)
    return rooms.read_prebuilt(spark, path, "src3").select("name", "text")


@query("select name, text from files where ext = '.txt'")
def scan_data_room(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the text documents as files of a room and scans it: room/{project}/{name}, one text per file."""
    path = scratch_dir(spark, "room")
    rows = corpus(spark, sf, "files").where("ext = '.txt'").select("name", "text")
    rows.repartition(8).write.partitionBy("name").option("lineSep", "\u0004").text(path)
    found = rooms.scan_data_room(spark, path, "part-*")
    name = F.regexp_extract("path", r"^name=([^/]+)/", 1)
    return found.select(name.alias("name"), F.regexp_replace("text", "\u0004$", "").alias("text"))


# sparse search

TOKENS = "list_filter(list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda v: replace(v, '_', '')), lambda v: length(v) > 1)"
BM25 = f"""
d as (select doc_id, {TOKENS.format(t="text")} as w from documents),
stats as (select count(*) as n, avg(len(w)) as avgdl, sum(len(w)) as total from d),
tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, stats),
mean as (select 0.25 * avg(raw) as floor from raw),
terms as (select term, df, case when raw < 0 then floor else raw end as idf from raw, mean),
q as (select item_id, term, count(*) as times from (select item_id, unnest({TOKENS.format(t="text")}) as term from benchmark) group by all),
scored as (select item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join terms using (term) join tf using (term), stats group by all)
"""


@query(f"select doc_id, array_to_string({TOKENS.format(t='text')}, ' ') as tokens from documents")
def legal_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "documents").select("doc_id", F.array_join(sparse.legal_tokenize(F.col("text")), " ").alias("tokens"))


@query(f"with {BM25} select term, df, round(idf, 6) as idf from terms")
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf, "documents")
    return sparse.term_stats(sparse.postings(docs, "doc_id"), sparse.corpus_stats(docs, "doc_id")).withColumn("idf", F.round("idf", 6))


@query(f"with {BM25} select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.bm25_search(corpus(spark, sf, "documents"), corpus(spark, sf, "benchmark"), "doc_id", "item_id")


@query(f"with {BM25} select n as n_docs, total::bigint as total_tokens, round(avgdl, 6) as avgdl from stats")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.corpus_stats(corpus(spark, sf, "documents"), "doc_id").withColumn("avgdl", F.round("avgdl", 6))


# streaming


@query(f"with {CHUNKS.replace('from documents', 'from (select min(doc_id) as doc_id, null as source, text from documents group by text)')}, t as (select doc_id, text from documents) select sha256(t.text) as content_hash, pos::int as pos, chunk from chunks join t using (doc_id)")
def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over a growing folder; which of equal texts is kept is open, so chunks are named by their content."""
    folder, out, mark = (scratch_dir(spark, n) for n in ("inbox", "store", "progress"))
    docs = corpus(spark, sf, "documents").select("doc_id", "text")
    docs.where("doc_id % 2 = 0").write.parquet(folder)
    ingest_and_read(spark, folder, "doc_id long, text string", out, mark)
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(folder)
    store = ingest_and_read(spark, folder, "doc_id long, text string", out, mark)
    return store.select("content_hash", "pos", "chunk")


def changing_index(spark: SparkSession, sf: str) -> SparseIndex:
    """Three runs: half of the documents; the others, with every fifth changed and the first files repeated; every fifteenth
    changed again and every seventh deleted."""
    folder, out, mark = (scratch_dir(spark, n) for n in ("inbox", "index", "progress"))
    docs = corpus(spark, sf, "documents").select("doc_id", "text")
    docs.where("doc_id % 2 = 0").write.parquet(folder)
    updated_index(spark, folder, out, mark)
    docs.where("doc_id % 2 = 0 and doc_id % 5 <> 0").unionAll(docs.where("doc_id % 2 = 1 and doc_id % 5 <> 0")).write.mode("append").parquet(folder)
    docs.where("doc_id % 5 = 0").select("doc_id", F.concat("text", F.lit(" amended closing terms"))).toDF("doc_id", "text").write.mode("append").parquet(folder)
    updated_index(spark, folder, out, mark)
    docs.where("doc_id % 15 = 0").select("doc_id", F.concat(F.lit("restated "), "text")).toDF("doc_id", "text").write.mode("append").parquet(folder)
    docs.where("doc_id % 7 = 0 and doc_id % 15 <> 0").select("doc_id", F.lit(None).cast("string").alias("text")).write.mode("append").parquet(folder)
    return updated_index(spark, folder, out, mark)


CHANGED = BM25.replace(
    "from documents",
    "from (select doc_id, case when doc_id % 15 = 0 then 'restated ' || text when doc_id % 5 = 0 then text || ' amended closing terms' else text end as text from documents where doc_id % 7 <> 0 or doc_id % 15 = 0)",
)


@query(f"with {CHANGED} select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10")
def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 hits from the index of three runs: those of the documents as they stand at the end."""
    return changing_index(spark, sf).search(corpus(spark, sf, "benchmark"), "item_id")
