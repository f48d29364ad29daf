"""Grouping of spelling variants by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced letter have letter counts at a squared distance of 1 or 2. Letters
fall into ``CLASSES`` classes of about equal frequency; words with equal numbers of letters in every class are a block,
and one edit leads into the same block, into one with a letter moved between two classes, or into one of the adjacent
length with a letter more. So only such blocks meet, as packed cells of bounded size; NumPy products of their letter
counts give all squared distances, and the pairs at the right distance are verified letter by letter.

Every word's form is its most frequent near word if that is ``FACTOR`` times as frequent; forms are followed to the last
by pointer jumping. A form is at least ten times as frequent as its word, so the number of rounds follows from the largest
count and nothing needs to be looked at between them.

Defined cases: a null text has no words, a null id counts as an empty text in the hash; of equally frequent near words the
first in code-point order is the form; repeated rows count again; runs of any length are words; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.shared import stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_TIMES = 7, 2
SAMPLED = 31  # the hashes that it divides lose a letter
FACTOR = 10
CLASSES = 5
CELL_WORDS, CELL_LETTERS = 1024, 1 << 20  # of a cell
SLICE_WORDS = 20_000  # whose letters a task counts at once
SLICE_COUNTS = 1 << 23  # of a slice's matrix, words by letters


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with at least ``LEAST_LETTERS`` letters and ``LEAST_TIMES`` occurrences.

    Only A-Z are lower-cased; where ``SAMPLED`` divides the crc32 of ``id:word``, the word's letter number crc32 modulo
    its length is left out first.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    plain = F.length("run") == F.octet_length("run")  # ASCII alone
    low = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % SAMPLED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def letter_classes(words: DataFrame, classes: int = CLASSES) -> list[str]:
    """The alphabet dealt into classes of about equal frequency; the driver sees one row per letter."""
    seen = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    out, load = [""] * classes, [0] * classes
    for letter, n in seen:
        least = load.index(min(load))
        out[least] += letter
        load[least] += n
    return out


def blocks_of(words: DataFrame, classes: list[str]) -> DataFrame:
    """Packed cells: (block, n_letters, cell, words, ns); a block has its letters by class as its key."""
    keyed = words.select("word", "n", F.length("word").alias("n_letters"), F.array(*[F.length("word") - F.length(F.translate("word", c, "")) if c else F.lit(0) for c in classes]).alias("block"))
    size = F.least(F.lit(CELL_WORDS), F.greatest(F.lit(1), F.lit(CELL_LETTERS) / F.col("n_letters")))
    sizes = keyed.groupBy("block", "n_letters").agg(F.count("*").alias("n_words")).select(F.col("block").alias("b"), F.ceil(F.col("n_words") / size).alias("n_cells"))
    placed = keyed.join(sizes.hint("merge"), keyed["block"] == sizes["b"])
    cell = F.pmod(F.xxhash64("word"), F.col("n_cells")).cast("int")
    return placed.groupBy("block", cell.alias("cell")).agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column, and where each row's begin and the last one's end."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.append(0, np.cumsum(sizes))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words as Latin-1 codes, and where each word begins and the last one ends."""
    joined = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    return np.frombuffer(b"".join(joined), np.uint8), np.append(0, np.cumsum(sizes))


def one_edit(codes: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a and b (numbers, b as long or a letter longer) differ by exactly one edit."""
    size = at[a + 1] - at[a]
    first = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(first, size)
    mine, other = codes[np.repeat(at[a], size) + inside], np.repeat(at[b], size) + inside
    longer = at[b + 1] - at[b] > size
    here = mine != codes[other]
    changed = np.add.reduceat(here.astype(np.int64), first) if len(first) else first
    # with a letter more, all places from the first difference on must be equal one letter later
    ahead = mine != codes[np.minimum(other + np.repeat(longer, size), len(codes) - 1)]
    before = np.minimum.reduceat(np.where(here, inside, np.iinfo(np.int64).max), first) if len(first) else first
    behind = np.maximum.reduceat(np.where(ahead, inside, -1), first) if len(first) else first
    return np.where(longer, behind < before, changed == 1)


def near_pairs(cells: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, near, near_n): every two words at one edit, both ways."""
    moves = [[0] * classes]
    moves += [[(k == j) - (k == i) for k in range(classes)] for i in range(classes) for j in range(i + 1, classes)]  # a letter replaced; the other way is the other block's
    moves += [[int(k == i) for k in range(classes)] for i in range(classes)]  # a letter more
    to = F.array(*[F.array(*map(F.lit, m)) for m in moves])
    left = cells.select("block", F.col("cell").alias("i"), F.col("words").alias("a"), F.col("ns").alias("a_n"), F.explode(F.transform(to, lambda m: F.zip_with("block", m, lambda x, y: x + y))).alias("other"))
    right = cells.select(F.col("block").alias("other"), F.col("cell").alias("j"), F.col("words").alias("b"), F.col("ns").alias("b_n"))
    own = F.col("block") == F.col("other")
    met = left.join(right.hint("merge"), "other").where(~own | (F.col("i") <= F.col("j"))).select("a", "a_n", "b", "b_n", (own & (F.col("i") == F.col("j"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                done = heavy[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(heavy, done + SLICE_WORDS, side="right")))
                yield pairs(batch.slice(begin, end - begin))
                begin = end

    def pairs(part: pa.RecordBatch) -> pa.RecordBatch:
        (a, a_at), (b, b_at) = _flat(part.column(0)), _flat(part.column(2))
        words, ns = pa.concat_arrays([a, b]), np.concatenate([part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 3)])
        codes, at = _codes(words)
        used, letter = np.unique(codes, return_inverse=True)
        size = np.diff(at)
        counts = np.bincount(np.repeat(np.arange(len(size)), size) * len(used) + letter, minlength=len(size) * len(used)).reshape(len(size), len(used)).astype(np.float32)
        square = (counts**2).sum(axis=1, dtype=np.float32)[:, None]
        one = np.ones_like(square)
        # the product of these two gives the squared distance itself
        x, y = np.hstack([counts, square, one]), np.hstack([-2 * counts, one, square])
        lefts, rights = [], []
        b_at = b_at + len(a)
        same = part.column(4).to_numpy(zero_copy_only=False)
        for r in range(part.num_rows):
            i0, i1, j0, j1 = a_at[r], a_at[r + 1], b_at[r], b_at[r + 1]
            apart = 2.0 if size[i0] == size[j0] else 1.0  # all words of a cell are as long
            i, j = np.nonzero(x[i0:i1] @ y[j0:j1].T == apart)
            i, j = i + i0, j + j0
            if same[r]:  # each pair of the cell once, both sides list the same words
                keep = i - i0 < j - j0
                i, j = i[keep], j[keep]
            lefts.append(i)
            rights.append(j)
        i, j = np.concatenate(lefts), np.concatenate(rights)
        good = one_edit(codes, at, i, j)
        i, j = i[good], j[good]
        return pa.RecordBatch.from_arrays([words.take(pa.array(np.concatenate([i, j]))), words.take(pa.array(np.concatenate([j, i]))), pa.array(ns[np.concatenate([j, i])])], ["word", "near", "near_n"])

    return met.mapInArrow(compare, "word string, near string, near_n long")


def followed(forms: DataFrame, most: int, factor: int = FACTOR) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last.

    ``most`` is the largest count: as counts grow ``factor``-fold along a chain, a chain has log(most) steps at most, and
    each round doubles the steps taken.
    """
    now = forms.select("word", F.col("form").alias("root"))
    steps = max(1, int(math.log(max(most, 2), factor)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(word_counts(docs, key, text), "words")
    cells = stored(blocks_of(words, letter_classes(words)), "cells")
    near = near_pairs(cells).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(near.hint("merge"), "word", "left")
    often = -F.col("best.m") >= factor * F.col("n")
    formed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = followed(formed.where("form is not null"), most, factor)
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
with recursive poly(i, c, k) as (
  select i, i::bigint, 0 from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end, k + 1 from poly where k < 8),
tab as (select list(c order by i) as v from poly where k = 8),
runs as (
  select coalesce(doc_id::varchar, '') as id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as r from documents) where length(r) >= 7 group by all),
coded as (select run, times, hex(encode(id || ':' || run)) as x from runs),
hashed as (
  select run, times, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint),
    lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h
  from coded, tab),
words as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(times)::bigint as n
  from hashed group by 1 having length(word) >= 7 and sum(times) >= 2),
cut as (select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as m from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * w.n then other end as form, case when m >= 10 * w.n then m end as form_n
  from words w left join best b on w.word = b.word),
chain(word, root) as (
  select word, form from formed where form is not null
  union all select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null)
select f.word, f.form, coalesce(c.root, f.word) as root, f.n, f.n_near, f.form_n
from formed f left join (select chain.word, chain.root from chain join formed on formed.word = chain.root where formed.form is null) c on c.word = f.word
"""
