"""Exact dense search: vector tables against blocks of query vectors, and what is built on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048  # queries that a task holds
CELLS = 1 << 21  # pairs of a query and a vector that are worked on at once
GROUP = 1 << 17  # vectors that stream by a block of queries


def _scan(vectors: DataFrame, key: str, vec: str, queries: DataFrame, query_key: str, query_vec: str, name: str, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Runs all queries over the vectors; ``pick`` gives, for queries, vectors and keys, the pairs to keep and their scores.

    Up to ``QUERY_BLOCK`` queries are handed to the tasks that scan the vectors. More are cut into blocks that meet groups of
    vectors: a task holds a block of queries while the vectors of a group stream by, so nothing passes through the driver.
    """
    types = {**dict(vectors.dtypes), **{f"?{k}": v for k, v in queries.dtypes}}
    schema = f"{query_key} {types[f'?{query_key}']}, {key} {types[key]}, {name} double"
    given = "array<float>" if types[vec] == types[f"?{query_vec}"] == "array<float>" else "array<double>"  # moved as narrow as they came
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast(given).alias("v"))
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_key).alias("q"), F.col(query_vec).cast(given).alias("v"))
    first = asked.limit(QUERY_BLOCK + 1).collect()  # a block and a row more
    matrix = lambda column: np.array(column.to_pylist(), float)

    def met(ids: pa.Array, q: np.ndarray, keys: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers, step = keys.to_numpy(zero_copy_only=False), max(1, CELLS // max(1, len(x)))
        for i in range(0, len(q), step):
            at, found, score = pick(q[i : i + step], x, numbers)
            yield pa.RecordBatch.from_arrays([ids.slice(i).take(pa.array(at)), keys.take(pa.array(found)), pa.array(score)], [query_key, key, name])

    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    if len(first) <= QUERY_BLOCK:
        held, block = [r[0] for r in first], np.array([r[1] for r in first], float)
        kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[types[f"?{query_key}"]]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = pa.array(held, kind)
            for b in batches:
                if b.num_rows:
                    yield from met(ids, block, b.column(0), matrix(b.column(1)))

        return rows.mapInArrow(scan, schema)
    blocks, groups = (df.agg(F.greatest(F.ceil(F.count("*") / n), F.lit(1)).alias(c)) for df, n, c in ((asked, QUERY_BLOCK, "n_blocks"), (rows, GROUP, "n_groups")))
    sizes = F.broadcast(blocks.crossJoin(groups))  # one row
    number = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    holds = asked.crossJoin(sizes).select(number("q", "n_blocks").alias("block"), every("n_groups").alias("group"), F.lit(False).alias("passing"), "q", F.lit(None).cast(types[key]).alias("k"), "v")
    passes = rows.crossJoin(sizes).select(every("n_blocks").alias("block"), number("k", "n_groups").alias("group"), F.lit(True).alias("passing"), F.lit(None).cast(types[f"?{query_key}"]).alias("q"), "k", "v")
    placed = holds.unionAll(passes).repartition("block", "group").sortWithinPartitions("block", "group", "passing")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, block = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            mark = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            bounds = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(bounds, bounds[1:], strict=False):
                if tuple(mark[:2, i]) != place:
                    place, ids, parts, block = tuple(mark[:2, i]), [], [], None
                part = b.slice(i, j - i)
                if not mark[2, i]:
                    ids.append(part.column(3))
                    parts.append(matrix(part.column(5)))
                elif ids:
                    block = np.concatenate(parts) if block is None else block
                    yield from met(pa.concat_arrays(ids), block, part.column(4), matrix(part.column(5)))

    return placed.mapInArrow(stream, schema)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared L2, rounded so that ties do not hang on the order of sums."""
    return np.round(np.maximum((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q @ x.T, 0), 6) + 0.0


def knn_l2(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", query_key: str = "query_id", query_vec: str = "query_vec", keep: float | None = None) -> DataFrame:
    """Exact top k by squared L2: query_key, key, dist, rank. Every task keeps its own best k per query, ties by key."""

    def pick(q: np.ndarray, x: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        d = _distances(q, x)
        near = np.stack([np.lexsort((keys, row))[:k] for row in d])
        at = np.repeat(np.arange(len(q)), near.shape[1])
        found = near.ravel()
        return [at, found, d[at, found]]

    best = _scan(vectors, key, vec, queries, query_key, query_vec, "dist", pick)
    if keep is not None:
        best = best.where(F.col("dist") <= keep)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy("dist", key))).where(F.col("rank") <= k)


def cosine_matrix(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vec: str = "embedding", query_key: str = "query_id", query_vec: str = "query_vec", least: float | None = None) -> DataFrame:
    """query_key, key, score: cosine of every query with every vector, or of those at least ``least`` alike."""

    def pick(q: np.ndarray, x: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        c = np.round(np.divide(q @ x.T, norms, out=np.zeros_like(norms), where=norms > 0), 6) + 0.0
        found, at = np.nonzero(c.T >= (-2 if least is None else least))  # by vectors: files hold repeating ids in few bytes
        return [at, found, c[at, found]]

    return _scan(vectors, key, vec, queries, query_key, query_vec, "score", pick)


def distance_to_similarity(dist: Column) -> Column:
    """Cosine of unit vectors from their squared distance, 0 beyond 2."""
    return F.when(dist <= 2, 1 - dist / 2).otherwise(0.0)


def semantic_search(vectors: DataFrame, queries: DataFrame, rescore: Callable[[DataFrame], DataFrame], top_k: int = 5, threshold: float = 0.2, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """Nearest max(20, 3k) by distance, those above the threshold, the best 15 rescored, the best k of these."""
    near = knn_l2(vectors, queries, max(20, 3 * top_k), key=key, query_key=query_key)
    like = near.withColumn("similarity", distance_to_similarity(F.col("dist"))).where(F.col("similarity") >= threshold)
    first = like.withColumn("r", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))).where("r <= 15")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.desc("similarity"), key))
    return rescore(first).withColumn("rank", rank).where(F.col("rank") <= top_k).select(query_key, key, "similarity", "score", "rank")


def search_documents(vectors: DataFrame | None, queries: DataFrame, rescore: Callable[[DataFrame], DataFrame], top_k: int = 5, threshold: float = 0.2, score_mode: str = "similarity", key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """Semantic search that gives no rows, with the right columns, where there is no index.

    ``score_mode="distance"`` compares the distance itself with the threshold, larger ones being kept, and ranks by it, as
    a literal reading of the score would; the default converts distances to similarities first.
    """
    kinds = {**{f"?{k}": v for k, v in queries.dtypes}, key: "long"} | ({} if vectors is None else {k: v for k, v in vectors.dtypes if k == key})
    if vectors is None:
        return queries.sparkSession.createDataFrame([], f"{query_key} {kinds[f'?{query_key}']}, {key} {kinds[key]}, similarity double, score double, rank int")
    if score_mode == "similarity":
        return semantic_search(vectors, queries, rescore, top_k, threshold, key, query_key)
    if score_mode != "distance":
        raise ValueError(f"no score mode {score_mode}")
    near = knn_l2(vectors, queries, max(20, 3 * top_k), key=key, query_key=query_key).where(F.col("dist") >= threshold)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("dist", key))
    return near.select(query_key, key, (1 - F.col("dist")).alias("similarity"), F.col("dist").alias("score"), rank.alias("rank")).where(F.col("rank") <= top_k)


def type_vectors(rows: DataFrame, type_column: str, embed: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """The rows with ``type_key`` (normalised) and its ``embedding``; each distinct type is embedded once, ``not classified`` not at all."""
    from foliant.operators.text import normalise_key

    keyed = rows.withColumn("type_key", normalise_key(F.col(type_column))).where("type_key <> 'not classified'")
    return keyed.join(embed(keyed.select("type_key").distinct(), "type_key", "embedding").hint("merge"), "type_key")


def multi_query_search(vectors: DataFrame, variants: DataFrame, texts: DataFrame, k: int, limit: float, key: str = "vec_id", focus: str = "focus_id") -> DataFrame:
    """Several vectors per focus: k nearest each within the limit, one row per focus and text (the nearest), by distance."""
    asked = variants.withColumn("query_id", F.concat_ws("#", focus, "variant"))
    near = knn_l2(vectors, asked, k, key=key, keep=limit).join(asked.select("query_id", focus).hint("merge"), "query_id")
    named = near.join(texts.hint("merge"), key)
    best = F.row_number().over(Window.partitionBy(focus, "text").orderBy("dist", key))
    kept = named.withColumn("b", best).where("b = 1")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(focus).orderBy("dist", key))).select(focus, "rank", key, "text", "dist")


def document_search(vectors: DataFrame, queries: DataFrame, texts: DataFrame, k: int = 8, limit: float = 1.5, key: str = "vec_id", query_key: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """The k nearest documents within the distance limit, with an excerpt around the query's words and a relevance."""
    from foliant.operators.text import best_excerpt

    near = knn_l2(vectors, queries, k, key=key, query_key=query_key, keep=limit)
    named = near.join(texts.select(key, "text").hint("merge"), key).join(queries.select(query_key, query_text).hint("merge"), query_key)
    return named.select(query_key, "rank", key, best_excerpt(F.col("text"), F.col(query_text)).alias("excerpt"), distance_to_similarity(F.col("dist")).alias("relevance"))


def focus_search(vectors: DataFrame, variants: DataFrame, texts: DataFrame, focus_text: Column, keywords: list[str], k: int, limit: float, top: int = 4, key: str = "vec_id", focus: str = "focus_id") -> DataFrame:
    """Several query variants per focus, the nearest texts, with an excerpt around the focus and the first keyword."""
    from foliant.operators.text import keyword_excerpt

    found = multi_query_search(vectors, variants, texts, k, limit, key, focus).where(F.col("rank") <= top)
    return found.select(focus, "rank", key, keyword_excerpt(F.col("text"), focus_text, keywords).alias("excerpt"))


def analysis_search(rows: DataFrame, queries: DataFrame, k: int = 5, limit: float = 1.5, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """The k nearest insight rows (key, type, name, embedding) within the limit."""
    near = knn_l2(rows, queries, k, key=key, query_key=query_key, keep=limit)
    return near.join(rows.select(key, "type", "name").hint("merge"), key).select(query_key, "rank", "type", "name", "dist")


def claim_support(claims: DataFrame, found: DataFrame, focus: str = "focus_id") -> DataFrame:
    """SUPPORTED from two sources, PARTIALLY SUPPORTED from one, UNSUPPORTED without."""
    n = found.groupBy(focus).agg(F.count("*").alias("n_sources"))
    count = F.coalesce("n_sources", F.lit(0))
    status = F.when(count >= 2, "SUPPORTED").when(count == 1, "PARTIALLY SUPPORTED").otherwise("UNSUPPORTED")
    return claims.select(focus).distinct().join(n.hint("merge"), focus, "left").select(focus, count.alias("n_sources"), status.alias("status"))


def hybrid_search(sparse: DataFrame, dense: DataFrame, key: str, query_key: str, top_k: int = 10, sparse_weight: float = 0.3, dense_weight: float = 0.7) -> DataFrame:
    """Weighted sum of both scores over the union of candidates; a side that lacks a row counts 0."""
    s, d = sparse.select(query_key, key, F.col("score").alias("s")), dense.select(query_key, key, F.col("score").alias("d"))
    both = s.join(d.hint("merge"), [query_key, key], "full_outer").select(query_key, key, F.coalesce("s", F.lit(0.0)).alias("sparse_score"), F.coalesce("d", F.lit(0.0)).alias("dense_score"))
    scored = both.withColumn("score", F.round(sparse_weight * F.col("sparse_score") + dense_weight * F.col("dense_score"), 8))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= top_k)


def embed_texts(df: DataFrame, text: str, embedder: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """Adds vectors by a caller's model; ``embedder`` makes it once per Python worker."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for p in parts:
            yield pd.Series(list(np.asarray(model(p.fillna("").tolist()), dtype=np.float32)))

    return df.withColumn(out, embed(text))


def hashed_embedder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Default model without weights: hashed words with signs, unit norm."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import zlib

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h & (1 << 30) else -1
            return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]

        return run

    return make


def rerank(pairs: DataFrame, query: str, text: str, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None) -> DataFrame:
    """Rescores (query, text) pairs: a caller's model, or the share of the query's words that the text has."""
    if scorer is None:
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
        asked = words(F.col(query))
        share = F.size(F.array_intersect(asked, words(F.col(text)))) / F.greatest(F.size(asked), F.lit(1))
        return pairs.withColumn("score", F.round(share, 6))

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for q, t in parts:
            yield pd.Series(model(q.tolist(), t.tolist()))

    return pairs.withColumn("score", run(query, text))
