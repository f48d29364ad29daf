"""Substring deduplication by content-defined chunking with a gear rolling hash.

The rolling hash runs over the bytes of a text and depends on the last 16. A chunk ends behind a word whose hash is the
smallest (of equal ones the first) among some ``NEAR`` words that follow each other, and in stretches of over ``MOST`` bytes
without such a place at the end of any character where a condition on the hash holds, so the cuts follow the content and
come back into step soon after an insertion. From every chunk on that follows the smallest hash among some ``FAR`` words, or
a place inside a stretch, the shortest run of chunks with at least ``min_words`` words is keyed by a 96-bit digest of its
text, as is the last such run of a text, up to its end; such a run that two documents hold is a repeated passage, so chunks from several other documents never make one. The
document with the smallest id keeps a passage, the others lose it; passages that touch or overlap are one span.

Every shared passage of 51 words is found: the hash of all but its first 8 words at most depends on the passage alone, so
by word 8 + ``FAR`` a run begins, and at most ``NEAR`` - 1 words behind its ``MIN_WORDS`` words it ends, at word 50 or before.
Repeats of fewer words than that never count, nor do so few
words that fill 256 KiB. Words stand between white space; in a longer word every further ``LONG_STEP`` bytes behind the first ``LONG_WORD`` count as one, so text
without blanks has words too.

Defined cases: null and empty texts have no chunk; a null doc_id is kept and comes first; rows with equal id and text are
one document, repeats inside one document are kept; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.shared import boxed, stored

MOST = 512
NEAR, FAR = 3, 12
INNER_CUT = 2048  # of 65,536 values of the hash, away from white space
LONG_WORD, LONG_STEP = 64, 8
MIN_WORDS = 28
NO_ID = -(2**63)
LENGTH_BITS, WORD_BITS = 18, 12
SCHEMA = "hi long, lo int, doc_id long, key long, loc long, wloc long"


def gear_table() -> np.ndarray:
    """256 fixed 16-bit values by a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(41)).astype(np.uint16)


GEAR = gear_table()


def _spaces(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _lowest(h: np.ndarray, ends: np.ndarray, near: int) -> np.ndarray:
    """The ends of words whose hash is the smallest of some ``near`` that follow each other."""
    if len(ends) < near:
        return ends[:0]
    at = np.lib.stride_tricks.sliding_window_view(h[ends - 1], near).argmin(axis=1)
    return ends[np.unique(at + np.arange(len(at)))]


def cuts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of a text's bytes, and for each chunk whether passages are keyed from it on."""
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for s in (1, 2, 4, 8):  # sum of the last 2, 4, 8, 16 table values, each shifted by its age
        h[s:] = h[s:] + (h[:-s] << np.uint16(s))
    n = len(b)
    space = np.append(_spaces(b), True)
    words = np.flatnonzero(~space[:-1] & space[1:]) + 1
    by_word = _lowest(h, words, NEAR)
    ends = by_word if n in by_word[-1:] else np.append(by_word, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST:
        final = np.append((b[1:] & 0xC0) != 0x80, True)  # the last byte of a character
        inner = np.flatnonzero(final & (h < INNER_CUT)) + 1
        wanted = [inner[slice(*np.searchsorted(inner, [ends[i] - gaps[i] + 1, ends[i]]))] for i in np.flatnonzero(gaps > MOST)]
        last, parts = 0, []
        for e in np.sort(np.concatenate([ends, *wanted])).tolist():
            while e - last > MOST:
                cut = last + MOST
                while (b[cut] & 0xC0) == 0x80:  # not inside a character
                    cut -= 1
                parts.append(cut)
                last = cut
            parts.append(e)
            last = e
        ends = np.array(parts, np.int64)
    passed = np.isin(ends[:-1], by_word) & ~np.isin(ends[:-1], _lowest(h, words, FAR))
    return ends, np.append(True, ~passed)


def word_starts(data: bytes) -> np.ndarray:
    """For each byte, whether a word starts there."""
    space = _spaces(np.frombuffer(data, np.uint8))
    starts = ~space
    starts[1:] &= space[:-1]
    begins, stops = np.flatnonzero(starts), np.flatnonzero(np.append(~space[:-1] & space[1:], not space[-1])) + 1
    for i in np.flatnonzero(stops - begins > LONG_WORD):
        starts[begins[i] + LONG_WORD : stops[i] : LONG_STEP] = True
    return starts


def passage_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(hi, lo, doc_id, key, loc, wloc): the shortest run of chunks with ``min_words`` words from every keyed chunk on, by digest.

    loc packs the start byte and the length (18 bits), wloc the first word's number and the words (12 bits).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["hi", "lo", "doc_id", "key", "loc", "wloc"]
        for batch in batches:
            digests, columns = [], [[] for _ in names[2:]]

            def flush() -> pa.RecordBatch:
                d = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                out = [np.ascontiguousarray(d[:, 0]), (d[:, 1] >> 32).astype(np.int32), *[np.concatenate(x) for x in columns]]
                digests.clear()
                for x in columns:
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

            for i, k, t in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                if not data:
                    continue
                e, keyed = cuts(data)
                s = np.append(0, e[:-1])
                total = np.append(0, np.cumsum(word_starts(data)))
                last = np.searchsorted(total[e], total[s] + min_words)
                fits = np.flatnonzero(last < len(e))
                if not len(fits):
                    continue
                own = fits[keyed[fits]]
                begin, end = np.append(s[own], s[fits[-1]]), np.append(e[last[own]], e[-1])  # the last run goes on to the end
                short = end - begin < 1 << LENGTH_BITS
                begin, end = begin[short], end[short]
                digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                words = np.minimum(total[end] - total[begin], (1 << WORD_BITS) - 1)
                found = (np.full(len(begin), NO_ID if i is None else i, np.int64), np.full(len(begin), k, np.int64), (begin << LENGTH_BITS) | (end - begin), (total[begin] << WORD_BITS) | words)
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
                if len(digests) > 50_000:
                    yield flush()
            if digests:
                yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text"), "text").mapInArrow(cut, SCHEMA)


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, key, n_shared_words, n_removed_words, first_docs, shared and removed spans (bytes, words)."""
    rows = stored(passage_rows(docs, min_words), "passages")
    held = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hi", "lo", "first")
    met = rows.join(held.hint("merge"), ["hi", "lo"]).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("loc", "wloc", "first"))).alias("at"))
    span = "struct<start:bigint,end:bigint,first_word:bigint,words:bigint>"

    def runs(at: str) -> F.Column:
        """Passages that touch or overlap made one."""
        none = F.array().cast(f"array<{span}>")
        start = F.struct(none.alias("out"), F.lit(None).cast(span).alias("run"))

        def step(s, x):
            begin, n = F.shiftright(x["loc"], LENGTH_BITS), x["loc"].bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
            word, w = F.shiftright(x["wloc"], WORD_BITS), x["wloc"].bitwiseAND(F.lit((1 << WORD_BITS) - 1))
            run, touches = s["run"], s["run"]["end"] >= begin
            one = F.struct(begin.alias("start"), (begin + n).alias("end"), word.alias("first_word"), w.alias("words"))
            end = F.greatest(run["end"], begin + n)
            more = F.struct(run["start"].alias("start"), end.alias("end"), run["first_word"].alias("first_word"), F.greatest(run["words"], word + w - run["first_word"]).alias("words"))
            done = F.when(touches | run.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(run)))
            return F.struct(done.alias("out"), F.when(touches, more).otherwise(one).alias("run"))

        end = lambda s: F.when(s["run"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["run"])))
        return F.transform(F.aggregate(at, start, step, end), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["words"].alias("words")))

    later = F.filter("at", lambda x: x["first"] < F.col("doc_id"))
    spans = met.select("doc_id", "key", "at", runs("at").alias("shared"), runs(later).alias("removed"))
    firsts = F.array_distinct(F.transform(later, lambda x: F.nullif(x["first"], F.lit(NO_ID))))
    found = spans.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "shared", "removed", firsts.alias("first_docs"))
    total = lambda a: F.coalesce(F.aggregate(a, F.lit(0).cast("long"), lambda s, r: s + r["words"]), F.lit(0).cast("long"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"))
    return ids.join(found.hint("merge"), (F.col("key") == F.col("k")) & (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("d")), "left").select(
        *["doc_id", "key"], total("shared").alias("n_shared_words"), total("removed").alias("n_removed_words"), "first_docs", "shared", "removed"
    )


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with removed spans cut from their texts; every column stays, text is replaced."""
    spans = shared_passages(docs, min_words).where(F.size("removed") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("key").alias("k"), "removed").distinct()
    own = docs.select(boxed(docs), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    joined = own.join(spans.hint("merge"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("d")), "left")
    raw = F.encode("doc.text", "UTF-8")
    keep = F.aggregate(
        "removed",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out")),
        lambda s, r: F.struct(r["end"].alias("at"), F.concat(s["out"], F.substring(raw, (s["at"] + 1).cast("int"), (r["start"] - s["at"]).cast("int"))).alias("out")),
        lambda s: F.concat(s["out"], F.substring(raw, (s["at"] + 1).cast("int"), F.length(raw))),
    )
    text = F.when(F.col("removed").isNotNull(), F.decode(keep, "UTF-8")).otherwise(F.col("doc.text"))
    return joined.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
