"""Entity resolution: pairs above a similarity, their components, exact average linkage inside each, merged rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.components import connected_components
from foliant.functions.shared import sent, stored

# Similarity that makes two rows of a type one entity, and how much the context counts.
THRESHOLDS = {"people": 0.85, "companies": 0.80, "financial_metrics": 0.90, "documents": 0.75, "legal_keywords": 0.95}
CONTEXT_WEIGHTS = {"people": 0.7, "companies": 0.6, "financial_metrics": 0.9, "documents": 0.5, "legal_keywords": 0.8}
DEFAULT_THRESHOLD, DEFAULT_WEIGHT = 0.8, 0.6
MOST_IN_COMPONENT = 20_000  # whose distances take 3.2 GB of the task
PIVOTED = 2048  # rows of a block that are not cut
PARTS = 16  # that a block is cut into at most, while they have no more rows than a cell
CELL = 1 << 15  # rows that a task holds while others pass by
PASSING = 1 << 20  # rows that pass by one task
PRODUCT = 1 << 22  # cosines that are computed at once
VERIFIED = 1 << 15  # pairs that are verified at once
MOST_TASKS = 1000


def entity_text(name: Column, context: Column, weight: Column) -> Column:
    """Name and context, the context cut to 150 characters where it weighs more than half, else to 50."""
    return F.concat_ws(" ", name, F.substring(context, F.lit(1), F.when(weight > 0.5, 150).otherwise(50)))


def normalise_entity_name(kind: Column, name: Column) -> Column:
    low = F.lower(F.trim(name))
    company = F.regexp_replace(low, r",?\s+(incorporated|inc|llc|corporation|corp|limited|ltd|company|co)\.?$", "")
    person = F.regexp_replace(low, r"^(mr|mrs|ms|dr|prof)\.?\s+", "")
    money = F.regexp_replace(low, r"[,$\s]", "")
    return F.when(kind == "companies", company).when(kind == "people", person).when(kind == "financial_metrics", money).otherwise(low)


def by_type(kind: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.coalesce(out, F.lit(default))


def threshold_of(kind: Column) -> Column:
    return by_type(kind, THRESHOLDS, DEFAULT_THRESHOLD)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def _sizes(rows: DataFrame) -> DataFrame:
    """Per block how many parts its rows are held in, and how many streams pass each."""
    n = F.count("*")
    size = F.least(F.lit(CELL), F.greatest(F.lit(PIVOTED), F.ceil(n / PARTS)))
    return stored(rows.groupBy("block").agg(F.ceil(n / size).cast("int").alias("n_parts"), F.ceil(n / PASSING).cast("int").alias("n_streams")), "sizes")


def _blocked(entities: DataFrame, blocks: list[str], threshold: Column) -> tuple[DataFrame, DataFrame]:
    rows = stored(entities.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"), threshold.alias("t"), F.to_json(F.struct(*blocks)).alias("block")), "rows")
    return rows, _sizes(rows)


def _placed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    met = rows.join(sent(sizes), "block")
    part, stream = (F.pmod(F.xxhash64("id", F.lit(name)), F.col(n)).cast("int") for name, n in (("part", "n_parts"), ("stream", "n_streams")))
    # a row is held by its part, in every stream, and passes the half of the other parts that follows it, in one stream
    holds = met.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("n_streams") - 1)).alias("stream"), F.lit(False).alias("passing"))
    ahead = met.select("*", part.alias("own"), stream.alias("stream"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n_parts") / 2).cast("int"))).alias("far"))
    to = ((F.col("own") + F.col("far")) % F.col("n_parts")).alias("part")
    passes = ahead.where((F.col("far") > 0) & ((2 * F.col("far") < F.col("n_parts")) | (F.col("own") < F.col("n_parts") / 2))).select("*", to, F.lit(True).alias("passing"))
    return holds.unionByName(passes, allowMissingColumns=True).select(F.concat_ws("|", "block", "part", "stream").alias("place"), "stream", "passing", "id", "vec", "t")


def placed_rows(entities: DataFrame, blocks: list[str], threshold: Column) -> DataFrame:
    """Where every row meets others: (place, stream, passing, id, vec, t); see ``similar_pairs``."""
    return _placed(*_blocked(entities, blocks, threshold))


def similar_pairs(entities: DataFrame, blocks: list[str], threshold: Column) -> DataFrame:
    """(a, b, score) with a < b inside blocks (type and a blocking key): cosine of ``vec`` at least the threshold of ``a``.

    A block of over ``PIVOTED`` rows is cut into parts, at most ``PARTS`` while they have at most ``CELL`` rows. A task holds
    a part while half of the others stream by, so every two rows meet once; what a product of floats does not rule out is
    verified.
    """
    return _compared(entities, blocks, threshold, False)


def similar_links(entities: DataFrame, blocks: list[str], threshold: Column) -> DataFrame:
    """(a, b, score): of the similar pairs those that connect the same rows; a row passing a part has a link, and its parts
    are joined once, so a large group of copies has links by its rows and not by their pairs."""
    return _compared(entities, blocks, threshold, True)


def _joining(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of labels the places of those that join two groups, and the labels of the groups."""
    differ = np.flatnonzero(a != b)
    if not len(differ):
        return differ, label
    once = differ[np.unique(a[differ] * len(label) + b[differ], return_index=True)[1]]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    kept = []
    for k in once.tolist():
        low, high = sorted((find(int(a[k])), find(int(b[k]))))
        if low != high:
            root[high] = low
            kept.append(k)
    to = np.arange(len(label))
    for x in root:
        to[x] = find(x)
    return np.array(kept, np.int64), to[label]


class _Held:
    """The rows of a part: names, unit vectors (also as floats, turned), thresholds, and which of them are known to be connected."""

    def __init__(self, parts: list[tuple]) -> None:
        self.name, self.x, self.t = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.narrow, self.label = np.ascontiguousarray(self.x.T, np.float32), np.arange(len(self.name))

    def pairs(self, other: tuple | None, forest: bool, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Pairs with rows that pass, or among the held ones; only links that join what is not yet connected if ``forest``."""
        inside = other is None
        name, x, t = (self.name, self.x, self.t) if inside else other
        narrow = x.astype(np.float32)
        # no product of floats is off by more
        least = min(self.t.min(), t.min()) - 2e-7 * (x.shape[1] + 16)
        size = max(1, PRODUCT // len(self.name))
        for s in range(0, len(name), size):
            e = min(s + size, len(name))
            first = s if inside else 0
            near = narrow[s:e] @ self.narrow[:, first:] >= least
            r, q = np.divmod(np.flatnonzero(near), near.shape[1])
            r, q = r + s, q + first
            if inside:
                r, q = r[r < q], q[r < q]
            if not len(r):
                continue
            if len(r) * 16 > near.size:
                score = (x[s:e] @ self.x.T)[r - s, q]
            else:
                score = np.concatenate([np.einsum("ij,ij->i", x[r[k : k + VERIFIED]], self.x[q[k : k + VERIFIED]]) for k in range(0, len(r), VERIFIED)])
            score = np.round(score, 6)
            swap = np.array(name[r] > self.name[q], bool)
            keep = score >= np.where(swap, self.t[q], t[r])
            r, q, score, swap = r[keep], q[keep], score[keep], swap[keep]
            if forest and len(r):
                new = np.concatenate([[True], r[1:] != r[:-1]]) & (not inside)  # the first link of a row that passes
                lead = r if inside else q[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
                joins, self.label = _joining(self.label[lead], self.label[q], self.label)
                new[joins] = True
                r, q, score, swap = r[new], q[new], score[new], swap[new]
            a, b = name[r], self.name[q]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a), ids), pa.array(np.where(swap, a, b), ids), pa.array(score)], ["a", "b", "score"])


def _compared(entities: DataFrame, blocks: list[str], threshold: Column, forest: bool) -> DataFrame:
    kind = dict(entities.dtypes)["id"]
    rows, sizes = _blocked(entities, blocks, threshold)
    places = sizes.agg(F.sum(F.col("n_parts") * F.col("n_streams"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, 4 * places))
    placed = _placed(rows, sizes).repartition(tasks, "place").sortWithinPartitions("place", "passing")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, parts, held = None, False, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.schema.field("id").type
            at, by = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (by[1:] != by[:-1])) + 1).tolist(), len(at)]
            vec = batch.column(4)
            name, x, t = batch.column(3).to_numpy(zero_copy_only=False), unit_rows(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)), batch.column(5).to_numpy()
            for i, j in zip(bounds, bounds[1:], strict=False):
                if (at[i] != place or by[i]) and parts:  # all that is held of a place is there
                    held = _Held(parts)
                    parts = []
                    if first:
                        yield from held.pairs(None, forest, ids)
                place, first = at[i], batch.column(1)[i].as_py() == 0
                if by[i]:
                    yield from held.pairs((name[i:j], x[i:j], t[i:j]), forest, ids)
                else:
                    parts.append((name[i:j], x[i:j], t[i:j]))
        if parts and first:
            yield from _Held(parts).pairs(None, forest, ids)

    return placed.mapInArrow(compare, f"a {kind}, b {kind}, score double")


def average_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of average-linkage clusters on cosine distance, merged while the mean distance is below the threshold.

    The nearest later row of every row is kept, so a merge looks at a few rows and not at all distances.
    """
    n, unit = len(x), unit_rows(x)
    d = unit @ unit.T
    np.subtract(1, d, out=d)
    np.round(d, 9, out=d)
    np.fill_diagonal(d, np.inf)
    size, label, rows = np.ones(n), np.arange(n), np.arange(n)
    near = np.array([i + 1 + d[i, i + 1 :].argmin() for i in range(n - 1)] + [n - 1], np.int64)
    least = d[rows, near]
    for _ in range(n - 1):
        i = int(least.argmin())
        j = int(near[i])
        if not least[i] < threshold:
            break
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        closer = (row[:i] < least[:i]) | ((row[:i] == least[:i]) & (near[:i] > i))
        lost = np.flatnonzero(((near[:j] == i) | (near[:j] == j)) & (least[:j] < np.inf))
        least[:i][closer], near[:i][closer] = row[:i][closer], i
        least[j] = np.inf
        for k in {i, *lost.tolist()}:
            if k < n - 1:
                near[k] = k + 1 + d[k, k + 1 :].argmin()
                least[k] = d[k, near[k]]
    return label


def cluster_entities(entities: DataFrame, pairs: DataFrame, threshold: Column) -> DataFrame:
    """(id, cluster): exact average linkage. Rows of different components never merge, so each component is one group.

    ``pairs`` are the similar pairs, or links that connect the same rows. A component of more than ``MOST_IN_COMPONENT`` rows
    fails loudly: raise the threshold or add a blocking key.
    """
    parts = connected_components(pairs.select("a", "b"))
    kind = dict(entities.dtypes)["id"]

    def labelled(rows: pa.Table) -> pa.RecordBatch:
        ids, vec, t, of = rows["id"].combine_chunks(), rows["vec"].combine_chunks(), rows["t"].to_numpy(), rows["component"].to_numpy()
        x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1).astype(float)
        bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        if (most := int(np.diff(bounds).max())) > MOST_IN_COMPONENT:
            raise ValueError(f"a component has {most} rows or more: raise the threshold or add a blocking key")
        first = [i + average_linkage(x[i:j], 1 - float(t[i])) for i, j in zip(bounds, bounds[1:], strict=False)]
        return pa.RecordBatch.from_arrays([ids, ids.take(pa.array(np.concatenate(first)))], ["id", "cluster"])

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components stand together, in order; the last one of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).to_numpy(zero_copy_only=False)
            if held and of[-1] == held[0].column(0)[0].as_py():
                if sum(b.num_rows for b in held) <= MOST_IN_COMPONENT:  # else it fails as it is
                    held.append(batch)
                continue
            last = int((of == of[-1]).argmax())
            if held or last:
                yield labelled(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield labelled(pa.Table.from_batches(held))

    rows = entities.select("id", "vec", threshold.alias("t")).join(parts.hint("merge"), "id").select("component", "id", "vec", "t")
    inside = rows.repartition("component").sortWithinPartitions("component", "id").mapInArrow(cluster, f"id {kind}, cluster {kind}")
    return entities.select("id").join(inside.hint("merge"), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def canonical_score(confidence: Column, context: Column, method: Column, name: Column) -> Column:
    quality = F.when(name.rlike(r"^[A-Z]") & (F.length(name) > 3), 1.0).otherwise(0.5)
    return F.round(0.4 * confidence + 0.3 * F.least(F.length(context) / 200, F.lit(1.0)) + F.when(method == "rich_pattern", 0.2).otherwise(0.1) + 0.1 * quality, 6)


def merge_clusters(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster: the canonical name (best score, larger id on ties), sources, contexts, size, mean confidence."""
    rows = entities.join(clusters.hint("merge"), "id").withColumn("s", canonical_score(F.col("confidence"), F.col("context"), F.col("extraction_method"), F.col("name")))
    return rows.groupBy("entity_type", "cluster").agg(
        F.max_by("name", F.struct("s", "id")).alias("name"),
        F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"),
        F.count("*").alias("cluster_size"),
        F.round(F.avg(F.nullif("confidence", F.lit(0.0))), 6).alias("confidence"),
        F.array_join(F.slice(F.array_sort(F.collect_set("context")), 1, 3), " | ").alias("contexts"),
    )


def resolve_entities(
    entities: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame] | None = None, threshold: Column | None = None, blocks: tuple[str, ...] = ()
) -> DataFrame:
    """Entities of all types with duplicates merged, in one job: entity_type, cluster, name, sources, cluster_size, confidence, contexts.

    ``entities``: id, entity_type, name, source, context, confidence, extraction_method, and ``vec`` unless ``embed``
    (rows, column of texts, column for vectors) is given, which then reads each entity's name and context once per
    distinct text. ``blocks`` are further columns that rows must share to be compared. Rows without a vector, and types
    with one row, come out as they are, as clusters of one; a null type is a type.
    """
    rows = entities
    if embed is not None:
        text = entity_text(F.trim("name"), F.trim("context"), by_type(F.col("entity_type"), CONTEXT_WEIGHTS, DEFAULT_WEIGHT))
        read = entities.drop("vec").withColumn("__text", text)
        vectors = embed(read.select("__text").distinct(), "__text", "vec").select("__text", "vec")
        rows = read.join(vectors.hint("merge"), "__text").drop("__text")
    rows = stored(rows, "entities")
    limit = threshold_of(F.col("entity_type")) if threshold is None else threshold
    links = stored(similar_links(rows, ["entity_type", *blocks], limit), "links")
    return merge_clusters(rows, cluster_entities(rows, links, limit))


def resolution_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, removed and percent per type and in total."""
    b = before.rollup("entity_type").agg(F.count("*").alias("n_before")).select(F.coalesce("entity_type", F.lit("total")).alias("entity_type"), "n_before")
    a = after.rollup("entity_type").agg(F.count("*").alias("n_after")).select(F.coalesce("entity_type", F.lit("total")).alias("entity_type"), "n_after")
    n = F.coalesce("n_after", F.lit(0))
    return b.join(a, "entity_type", "left").select("entity_type", "n_before", n.alias("n_after"), (F.col("n_before") - n).alias("removed"), F.round(100.0 * (F.col("n_before") - n) / F.col("n_before"), 2).alias("percent"))
