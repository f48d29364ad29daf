"""Chunking and text preparation (all JVM-side expressions except the recursive splitter)."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foliant.functions.shared import global_rank

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
# The separators of the recursive splitter, in order.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", ".\n", "! ", "? ", "; ", ", ", " ", "")
NO_LETTER = r"[^\p{L}\p{Nd}\p{Mn}_]"
TEXTS_AT_ONCE = 1024  # that Arrow scans
_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœ", "aaaaaaceeeeiiiinooooouuuuyyo"
_MARKS = "‘’‚‛“”„–—−‐‑‒", "''''\"\"\"------"


def chunk_fixed(df: DataFrame, key: str, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters that share ``overlap`` with the next: key, pos, chunk."""
    if size <= overlap:
        raise ValueError("size must be above overlap")
    last = F.greatest(F.lit(1), F.length(text) - overlap)
    starts = df.select("*", F.posexplode(F.sequence(F.lit(1), last, F.lit(size - overlap))).alias("pos", "__at"))
    others = [c for c in df.columns if c not in (key, text)]
    return starts.select(key, *others, "pos", F.substring(F.col(text), F.col("__at"), F.lit(size)).alias("chunk"))


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Cuts at the first separator that occurs, goes on with the next one inside pieces that are still too long, and
    joins neighbours up to ``size`` with up to ``overlap`` characters of the chunk before."""
    pieces, todo = [], [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= size:
            pieces.append(part)
            continue
        while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in part:
            level += 1
        mark = SEPARATORS[level]
        if not mark:
            pieces += [part[i : i + size] for i in range(0, len(part), size)]
            continue
        cut = part.split(mark)
        todo += [(p, level + 1) for p in reversed([cut[0], *(mark + c for c in cut[1:])]) if p]
    chunks, held, length = [], [], 0
    for p in pieces:
        if length + len(p) > size and held:
            chunks.append("".join(held).strip())
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def chunk_recursive(df: DataFrame, key: str, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """key, pos, chunk by the recursive splitter, whole documents at a time, in Arrow batches."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(split_recursive(t or "", size, overlap))]
            if rows:
                keys, at, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema[0].type), pa.array(at, pa.int32()), pa.array(out)], [b.schema.names[0], "pos", "chunk"])

    return df.select(key, text).mapInArrow(split, f"{key} {dict(df.dtypes)[key]}, pos int, chunk string")


@F.udtf(returnType="pos int, chunk string")
class RecursiveChunks:
    """The recursive splitter as a table function: rows of (pos, chunk) for a text; none for a null or empty one."""

    def eval(self, text: str, size: int, overlap: int):
        for pos, chunk in enumerate(split_recursive(text or "", size, overlap)):
            yield pos, chunk


def chunks_of(df: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Every column of the rows beside each chunk of their text (pos, chunk), by a lateral join with the table function."""
    return df.lateralJoin(RecursiveChunks(F.col(text).outer(), F.lit(size), F.lit(overlap)))


def chunk_stats(chunks: DataFrame, source: str = "source", key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Documents, chunks and first chunks per source."""
    return chunks.groupBy(source).agg(F.count_distinct(key).alias("documents"), F.count("*").alias("chunks"), F.count_if(F.col(pos) == 0).alias("first_chunks"))


def written_with_stats(chunks: DataFrame, path: str, key: str = "doc_id", pos: str = "pos", text: str = "chunk") -> dict:
    """Writes chunks and gives figures observed in that same pass: chunks, first_chunks, n_chars, empty, and chunks_per_second."""
    seen = Observation("chunks")
    figures = [F.count("*").alias("chunks"), F.count_if(F.col(pos) == 0).alias("first_chunks"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty")]
    began = time.monotonic()
    chunks.observe(seen, *figures).write.parquet(path)
    return {**seen.get, "chunks_per_second": seen.get["chunks"] / max(1e-9, time.monotonic() - began)}


def number_chunks(chunks: DataFrame, order: list[str], store: str | None = None) -> DataFrame:
    """Adds chunk_id ``chunk_{i}``: per store, or over all rows by distributed ranks."""
    if store is None:
        ranked = global_rank(chunks, [F.col(c) for c in order], "__n")
    else:
        ranked = chunks.withColumn("__n", F.row_number().over(Window.partitionBy(store).orderBy(*order)) - 1)
    return ranked.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("__n"))).drop("__n")


def mark_first_chunk(chunks: DataFrame, source: str, pos: str = "pos") -> DataFrame:
    return chunks.withColumn("is_first_chunk", F.row_number().over(Window.partitionBy(source).orderBy(pos)) == 1)


def citation_label(page: Column, name: Column) -> Column:
    """``page N``, else the name, else ``document``."""
    return F.coalesce(F.concat(F.lit("page "), page.cast("string")), name, F.lit("document"))


def normalise_key(text: Column) -> Column:
    """Lower case, trimmed, accents of Latin letters removed, dashes and curly quotes plain."""
    return F.trim(F.translate(F.translate(F.lower(text), *_ACCENTS), *_MARKS))


def escape_markdown_math(text: Column) -> Column:
    for mark in ("$", "\\(", "\\)", "\\[", "\\]"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def truncate_text(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def regex_spans(df: DataFrame, text: str, pattern: str, groups: int = 0) -> DataFrame:
    """A row per match with match, start, end (characters from 0) and groups g1..gn. The pattern must not match empty."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    wide = df.where(F.col(text).rlike(pattern)).select("*", found.alias("__m"), F.transform(gaps, F.length).alias("__g"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"__{g}") for g in range(1, groups + 1)])
    groups_ = [f"__{g}" for g in range(1, groups + 1)]
    none = F.array().cast("array<int>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["g"] + x["n"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["g"])).alias("out"))
    pairs = F.zip_with(F.slice("__g", F.lit(1), F.size("__m")), F.transform("__m", F.length), lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    paired = wide.select(*df.columns, "__m", *groups_, pairs.alias("__p"))
    # running sums in blocks, then over the blocks: growing one array would copy it for every match
    block = 256
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("__p") / block).cast("int") - 1, F.lit(0)))
    inside = F.transform(numbers, lambda b: F.aggregate(F.slice("__p", b * block + 1, F.lit(block)), empty, step))
    blocked = paired.select(*df.columns, "__m", *groups_, inside.alias("__b"))
    before = F.aggregate("__b", empty, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    starts = F.flatten(F.zip_with("__b", before, lambda b, o: F.transform(b["out"], lambda x: x + o)))
    placed = blocked.select(*df.columns, F.posexplode(starts).alias("__i", "start"), "__m", *groups_)
    match = F.get("__m", F.col("__i"))
    return placed.select(*df.columns, match.alias("match"), "start", (F.col("start") + F.length(match)).alias("end"), *[F.get(f"__{g}", F.col("__i")).alias(f"g{g}") for g in range(1, groups + 1)])


def masked(x: pa.Array) -> pa.Array:
    """Texts of the same length in ASCII: other letters, digits and marks are underscores, other signs a control character.

    Arrow's word boundary knows ASCII only; on these texts it is that of all letters.
    """
    if pc.sum(pc.binary_length(x)).as_py() == pc.sum(pc.utf8_length(x)).as_py():
        return x
    return pc.replace_substring_regex(pc.replace_substring_regex(x, r"[^\x00-\x7F\p{L}\p{Nd}\p{Mn}]", "\x01"), r"[^\x00-\x7F]", "_")


def _places(x: pa.Array, pattern: str, before: int, behind: int) -> pa.Array:
    """A list of (start, end, match, before, behind) for every text.

    Matches are put between marks that no ASCII text has, and the texts cut there.
    """
    texts = pc.fill_null(x, "")
    parts = pc.split_pattern(pc.replace_substring_regex(masked(texts), pattern, "§\\0§"), "§")
    n, lengths = parts.value_lengths().to_numpy(), pc.binary_length(parts.flatten()).to_numpy()
    first = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(lengths)
    ends -= np.repeat(np.concatenate([[0], ends])[first[:-1]], n)
    inside = (np.arange(len(ends)) - np.repeat(first[:-1], n)) % 2 == 1
    start, end = (ends - lengths)[inside], ends[inside]
    hit = np.flatnonzero(n > 1)  # only texts with a match are read
    spans = list(zip(np.repeat(np.arange(len(hit)), n[hit] // 2).tolist(), start.tolist(), end.tolist(), strict=True))
    text = texts.take(pa.array(hit)).to_pylist()
    found = [[text[i][s:e] for i, s, e in spans], [text[i][max(0, s - before) : s] for i, s, e in spans], [text[i][e : e + behind] for i, s, e in spans]]
    at = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), *[pa.array(f, pa.string()) for f in found]], names=["start", "end", "match", "before", "behind"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n // 2)]), pa.int32()), at)


def arrow_spans(df: DataFrame, text: str, pattern: str, before: int, behind: int) -> DataFrame:
    """A row per match with match, start, end (characters from 0) and so many characters before and behind it.

    Each text is scanned once, by Arrow, and not carried into the rows of its matches. Of characters beyond ASCII the pattern
    may only ask that they are not its own: it sees ``masked`` texts.
    """

    @F.arrow_udf("array<struct<start:int,end:int,match:string,before:string,behind:string>>")
    def places(x: pa.Array) -> pa.Array:
        return pa.concat_arrays([_places(x.slice(s, TEXTS_AT_ONCE), pattern, before, behind) for s in range(0, max(1, len(x)), TEXTS_AT_ONCE)])

    others = [c for c in df.columns if c != text]
    placed = df.select(*others, F.posexplode(places(F.col(text))).alias("__i", "__at"))
    return placed.select(*others, "__at.match", "__at.start", "__at.end", "__at.before", "__at.behind")


def arrow_pattern(pattern: str) -> str:
    """A pattern for ``arrow_group``: its group is named ``v``, and a word boundary at either end is that of all letters."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body = re.sub(r"(?<!\\)\((?!\?)", "(?P<v>", pattern.removeprefix(flag), count=1)
    body = f"(?:^|{NO_LETTER}){body[2:]}" if body.startswith(r"\b") else body
    return flag + (f"{body[:-2]}(?:{NO_LETTER}|$)" if body.endswith(r"\b") else body)


def arrow_group(x: pa.Array, pattern: str, name: str = "v") -> pa.Array:
    """A named group of the first match in every text, null without one."""
    return pc.struct_field(pc.extract_regex(x, pattern), name)


def literal(text: Column) -> Column:
    """A pattern that matches just the text."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def replaced_once(text: Column, pattern: Column, found: Callable[[Column], Column]) -> Column:
    """Every match of a pattern replaced by ``found(match)``, in one pass: what is put in is not looked at again."""
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    put = F.zip_with(gaps, F.transform(matches, lambda m: F.coalesce(found(m), m)), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.array_join(put, "")


def context_window(text: Column, start: Column, end: Column, n: int) -> Column:
    """The text from n characters before a span to n after it, clamped."""
    first = F.greatest(start - n, F.lit(0))
    return F.substring(text, first + 1, end + n - first)


def best_excerpt(text: Column, query: Column, before: int = 100, after: int = 300, start: int = 400) -> Column:
    """Text around the first place of the query, with dots where it is cut; the first characters if there is none."""
    at = F.locate(F.lower(query), F.lower(text)) if isinstance(query, str) else F.instr(F.lower(text), F.lower(query))
    first = F.greatest(at - 1 - before, F.lit(0))
    last = F.least(at - 1 + after, F.length(text))
    cut = F.concat(F.when(first > 0, "...").otherwise(""), F.substring(text, first + 1, last - first), F.when(last < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, start))


def keyword_excerpt(text: Column, focus: Column, keywords: list[str], before: int = 100, after: int = 350) -> Column:
    """Around the earlier of the focus and the first keyword of the list that occurs; null unless both occur."""
    low = F.lower(text)
    found = F.get(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.instr(low, k) > 0), 0)
    here = F.instr(low, F.lower(focus))
    at = F.least(here, F.instr(low, found)) - 1
    first = F.greatest(at - before, F.lit(0))
    return F.when((here > 0) & found.isNotNull(), F.substring(text, first + 1, at + after - first))
