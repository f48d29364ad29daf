"""Toxicity by a factorization machine over hashed terms.

The score is a logistic function of ``b + sum(w_i) + sum over pairs <v_i, v_j>`` over the distinct terms of the whole text,
so a pair of terms (an insult with a group mention) can count more or less than both alone. Terms are words and word
starts, hashed; the terms most associated with the label in the training rows have weights, others have none.

Training is one task over a bounded sample: at most ``MOST_ROWS`` labelled ids (those with the smallest hash of their id)
with texts of ``MOST_BYTES`` in all, never ids whose crc32 mod 3 is 1. Only the label and the text are read. The model is
some 100 KB.

Defined cases: a null or empty text has no term and scores the model's bias; a null doc_id is not held out and cannot be
labelled; contradicting labels of one id count as toxic, of several texts of one id the one with the smallest hash trains;
without labels every score is 0; repeated rows get equal scores; other columns are ignored or, in ``clean_documents``, kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shared import stored

HASH_BITS = 22
STARTS = (4, 5, 6, 7)
FEATURES = 2048
FACTORS = 4
LEAST_Z = 3.0  # of a term's association with the label
MOST_ROWS = 5000
MOST_BYTES = 64 << 20
STEPS = 250
LIMIT = 0.7
REMEMBERED = 100_000  # words and word starts
BATCH_ROWS = 256
WORD = re.compile(r"[^\W_]+")


def held_out() -> Column:
    """True for the third of the ids that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Terms(dict):
    """Hashed terms of a word, the word and its longer starts, remembered; only those of a model if one is given."""

    def __init__(self, only: np.ndarray | None = None) -> None:
        super().__init__()
        self.only = None if only is None else set(only.tolist())
        self.starts: dict[str, tuple[int, ...]] = {}

    def _hash(self, form: str) -> tuple[int, ...]:
        h = zlib.crc32(form.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)
        return (h,) if self.only is None or h in self.only else ()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) + len(self.starts) > REMEMBERED:
            self.clear()
            self.starts.clear()
        out = self._hash(f"={word}")
        for n in STARTS:
            if len(word) >= n:
                start = word[:n]
                if start not in self.starts:
                    self.starts[start] = self._hash(start)
                out += self.starts[start]
        self[word] = out
        return out


def text_terms(text: str, terms: Terms) -> np.ndarray:
    """The distinct hashed terms of a text."""
    words = set(WORD.findall(text.lower()))
    return np.sort(np.fromiter(set(chain.from_iterable(map(terms.__getitem__, words))), np.int32))


def fit(texts: list[np.ndarray], labels: np.ndarray) -> bytes:
    """Trains on distinct terms and 0/1 labels; returns b, feature ids, w and V as one float64/int64 buffer."""
    n, pos = len(labels), max(1, int(labels.sum()))
    if n == 0 or labels.sum() == 0 or labels.sum() == n:
        return np.array([-30.0 if labels.sum() == 0 else 30.0]).tobytes()
    df, toxic = np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS, np.int32)  # a text has each term once
    for t, y in zip(texts, labels, strict=True):
        df[t] += 1
        if y:
            toxic[t] += 1
    ids = np.flatnonzero(df >= 3)
    df, toxic = df[ids].astype(np.float64), toxic[ids].astype(np.float64)
    rate = pos / n
    z = np.abs(toxic - df * rate) / np.sqrt(df * rate * (1 - rate) + 1)
    chosen = np.sort(np.argsort(-z, kind="stable")[: min(FEATURES, int((z >= LEAST_Z).sum()))])
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[ids[chosen]] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    for i, t in enumerate(texts):
        at = place[t]
        x[i, at[at >= 0]] = 1
    rng = np.random.default_rng(3)
    params = [np.array([np.log(rate / (1 - rate))], np.float32), np.zeros(len(chosen), np.float32), (rng.standard_normal((len(chosen), FACTORS)) * 0.01).astype(np.float32)]
    weight = np.where(labels == 1, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    weight /= weight.sum()
    decay = (0.0, 1e-5, 5e-5)
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, STEPS + 1):
        b, w, v = params
        xv = x @ v
        f = b[0] + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        err = weight * (1 / (1 + np.exp(-np.clip(f, -30, 30))) - labels)
        xe = x.T @ err
        grads = [np.array([err.sum()]), xe, x.T @ (err[:, None] * xv) - v * xe[:, None]]
        for i, g in enumerate(grads):
            g = g + decay[i] * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            params[i] = (params[i] - 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    b, w, v = [p.astype(np.float64) for p in params]
    return b.tobytes() + ids[chosen].astype(np.int64).tobytes() + w.tobytes() + v.tobytes()


class Model:
    """The trained weights, laid out by feature."""

    def __init__(self, data: bytes) -> None:
        n = (len(data) - 8) // (8 * (2 + FACTORS))
        self.bias = np.frombuffer(data, np.float64, 1)[0]
        self.ids = np.frombuffer(data, np.int64, n, 8)
        self.w = np.frombuffer(data, np.float64, n, 8 + 8 * n)
        self.v = np.frombuffer(data, np.float64, n * FACTORS, 8 + 16 * n).reshape(n, FACTORS)
        self.square = (self.v**2).sum(axis=1)

    def score(self, found: np.ndarray) -> float:
        """The probability for distinct terms."""
        f = self.bias
        if len(self.ids) and len(found):
            at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
            at = at[self.ids[at] == found]
            f = f + self.w[at].sum() + 0.5 * ((self.v[at].sum(axis=0) ** 2).sum() - self.square[at].sum())
        return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> bytes:
    """Fits the model in one task over a bounded sample of labelled rows outside the held-out third."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # at most most_rows rows of two numbers; lengths and hashes are chosen among before any text moves
    known_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    sized = known_docs.select("doc_id", "y", F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")).alias("t")).where(F.col("t.size") <= MOST_BYTES)
    one = sized.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("t").alias("t"))
    order = (F.xxhash64("doc_id"), "doc_id")
    until = F.sum("t.size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # one task: most_rows rows of four numbers
    chosen = stored(one.select("doc_id", "t.hash", until.alias("until")).where(F.col("until") <= MOST_BYTES).drop("until"), "sample")
    picked = known_docs.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"])
    bounded = picked.groupBy("doc_id").agg(F.first("text").alias("text"), F.min("y").alias("y"))  # MOST_BYTES of text

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found, labelled = Terms(), [], []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found += [text_terms(t, terms) for t in part.column(1).to_pylist()]
                labelled += part.column(2).to_pylist()
        terms.clear()
        yield pa.RecordBatch.from_arrays([pa.array([fit(found, np.array(labelled, np.float32))], pa.binary())], ["model"])

    trained = bounded.select("doc_id", "text", "y").repartition(1).sortWithinPartitions(*order).mapInArrow(learn, "model binary").first()
    return bytes(trained[0]) if trained else fit([], np.zeros(0, np.float32))


def score_of(text: Column, model: bytes) -> Column:
    """The score of whole texts; only the texts go through Python, a few at a time."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(model)
        terms = Terms(known.ids)
        for part in parts:
            yield pa.array([known.score(text_terms(t or "", terms)) for at in range(0, len(part), BATCH_ROWS) for t in part.slice(at, BATCH_ROWS).to_pylist()], pa.float64())

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    scored = docs.select("doc_id", score_of(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    return docs.where(score_of(F.col("text"), train(docs, labels)) < limit)
