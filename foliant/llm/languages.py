"""Language identification by mixture inference: the shares of languages in a document by expectation-maximisation.

Every letter, folded to lower case, gives the trigram around it (words are bounded by one blank); counts of hashed
trigrams per language over all learning rows give each trigram's likelihood. A document's words, cut every ``UNIT``
letters, are its observations: a word's likelihood in a language is the product of its trigrams'. Expectation-maximisation
finds the shares of the languages; sets of the largest 1, 2, ... shares are fitted again, and the one with the best
likelihood less a penalty for each further language is the document's. Its largest share is the prediction.

The model is one table of languages by ``2**BITS`` buckets, summed in Spark over all learning rows; its size is bounded by
``MOST_CELLS`` (with more languages, fewer buckets), so the driver may pass it to the tasks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing can be
learned; rows with a null language are not learned from; a null id is not held out; other columns are ignored; repeated
rows get equal results; an empty table gives no row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 17
MOST_CELLS = 1 << 24  # of the model: 64 MB
UNIT = 12  # letters that are one observation at most
ALPHA = 0.05  # added to every count
PENALTY = 3.0  # per further language, times the logarithm of the number of words
ROUNDS, MORE_ROUNDS = 12, 6
SLICE_LETTERS = 1 << 19  # scored at once; with many languages fewer
HELD_TABLES = 64  # languages that a counting task keeps before it hands them on
UNKNOWN = "und"
RESULT = "struct<lang_pred:string,score:double,langs:array<string>,shares:array<double>>"


@cache
def folding() -> np.ndarray:
    """For every code point the lower-case letter, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def letters(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The trigram bucket around every letter, and whether the letter begins an observation."""
    code = folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    is_letter = code > 0
    if not is_letter.any():
        return np.zeros(0, np.int32), np.zeros(0, bool)
    held = is_letter.copy()
    held[1:] |= is_letter[:-1]  # one blank behind every word
    line = np.concatenate([[0], code[held], [0]]).astype(np.uint32)
    if not is_letter[0]:
        line = line[line.nonzero()[0][0] - 1 :]
    at = np.flatnonzero(line)
    h = line[at - 1] * np.uint32(0x9E3779B1) + line[at] * np.uint32(0x85EBCA6B) + line[at + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    first = line[at - 1] == 0
    begun = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return (h >> np.uint32(32 - bits)).astype(np.int32), (np.arange(len(at)) - begun) % UNIT == 0


def held_out() -> Column:
    """True for the third of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Languages and the log likelihood of every bucket in each."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.bits = langs, int(counts.shape[1]).bit_length() - 1
        total = counts.sum(axis=1, keepdims=True) + ALPHA * counts.shape[1]
        self.table = np.ascontiguousarray(np.log((counts + ALPHA) / total).T.astype(np.float32))


def learn(docs: DataFrame, bits: int = BITS) -> Model | None:
    """Counts the trigrams of all rows outside the held-out third by language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("lang").cast("string"), "text")
    langs = sorted(r[0] for r in known.select("lang").distinct().limit(MOST_CELLS // 1024 + 1).collect())
    if not langs:
        return None
    if len(langs) > MOST_CELLS // 1024:
        raise ValueError(f"more than {MOST_CELLS // 1024} languages")
    while len(langs) << bits > MOST_CELLS:
        bits -= 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, t in tables.items():
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], ["lang", "bucket", "n"])
            tables.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column(0)[i].as_py()
                if lang not in tables:
                    if len(tables) == HELD_TABLES:
                        yield from handed()
                    tables[lang] = np.zeros(1 << bits, np.int64)
                tables[lang] += np.bincount(letters(batch.column(1)[i].as_py(), bits)[0], minlength=1 << bits)
        yield from handed()

    sums = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # MOST_CELLS rows at most
    counts = np.zeros((len(langs), 1 << bits))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[[place[x] for x in sums["lang"].to_pylist()], sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return Model(langs, counts)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def fitted(like: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds of expectation-maximisation, and the log likelihood of every document under them.

    ``like`` has a row for each observation, its likelihoods divided by the largest; documents begin at ``starts``.
    """
    n = np.diff(np.append(starts, len(like)))
    for _ in range(rounds):
        part = like * np.repeat(share, n, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = _sums(part, starts) / n[:, None]
    return share, _sums(np.log(np.maximum((like * np.repeat(share, n, axis=0)).sum(axis=1), 1e-300)), starts)


def shares_of(log_like: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The shares of the languages in documents with at least one observation each; 0 outside the chosen set."""
    k = log_like.shape[1]
    n = np.diff(np.append(starts, len(log_like)))
    top = log_like.max(axis=1, keepdims=True)
    like = np.exp(log_like - top)
    share, _ = fitted(like, starts, np.full((len(starts), k), 1 / k), ROUNDS)
    alone = _sums(log_like - top, starts)
    best = alone.argmax(axis=1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(starts)), best] = 1
    value = alone[np.arange(len(starts)), best]
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, k + 1):
        # a language with less than a word is none
        live = np.flatnonzero(share[np.arange(len(starts)), order[:, size - 1]] * n >= 1)
        if not len(live):
            break
        allowed = np.zeros((len(live), k))
        np.put_along_axis(allowed, order[live, :size], 1, axis=1)
        some = share[live] * allowed
        rows = np.repeat(np.isin(np.arange(len(starts)), live), n)
        begins = np.cumsum(n[live]) - n[live]
        refit, total = fitted(like[rows], begins, some / some.sum(axis=1, keepdims=True), MORE_ROUNDS)
        total = total - PENALTY * (size - 1) * np.log(n[live] + 1)
        better = total > value[live]
        chosen[live[better]] = refit[better]
        value[live[better]] = total[better]
    return chosen


def language_of(text: Column, model: Model | None) -> Column:
    """A struct of the predicted language, its share, and the set of languages with their shares, largest first."""

    @F.arrow_udf(RESULT)
    def tell(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
        nothing = {"lang_pred": UNKNOWN, "score": 0.0, "langs": [], "shares": []}
        most = SLICE_LETTERS if model is None else max(1 << 14, SLICE_LETTERS * 4 // max(4, len(model.langs)))

        def slice_of(found: list[tuple[int, np.ndarray, np.ndarray]], out: list[dict]) -> None:
            # a long text is summed in pieces; every piece begins an observation
            rows, starts, begun = [], [], 0
            for _, at, first in found:
                begins = np.flatnonzero(first)
                cut = [*range(0, len(begins), max(1, most // UNIT)), len(begins)]
                for i, j in zip(cut, cut[1:], strict=False):
                    a, b = begins[i], begins[j] if j < len(begins) else len(at)
                    rows.append(_sums(model.table[at[a:b]].astype(np.float64), begins[i:j] - a))
                starts.append(begun)
                begun += len(begins)
            for (i, _, _), share in zip(found, shares_of(np.concatenate(rows), np.array(starts)), strict=True):
                order = [x for x in np.argsort(-share, kind="stable").tolist() if share[x] > 0]
                out[i] = {"lang_pred": model.langs[order[0]], "score": min(1.0, float(share[order[0]])), "langs": [model.langs[x] for x in order], "shares": [float(share[x]) for x in order]}

        for part in parts:
            out, held, size = [nothing] * len(part), [], 0
            for i in range(len(part)):
                at, first = letters(part[i].as_py() or "", model.bits if model else BITS)
                if not len(at) or model is None:
                    continue
                held.append((i, at, first))
                size += len(at)
                if size >= most:
                    slice_of(held, out)
                    held, size = [], 0
            if held:
                slice_of(held, out)
            yield pa.array(out, kind)

    return tell(text)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the set of languages with their shares."""
    model = learn(docs)
    told = docs.select("doc_id", held_out().alias("held_out"), language_of(F.col("text"), model).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score", "told.langs", "told.shares")
