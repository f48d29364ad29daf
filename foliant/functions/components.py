"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component) for every node that has an edge; a component is named by its smallest node.

    Each round shrinks the distance to the smallest node, so rounds grow with the logarithm of a component's diameter.
    The driver sees a count and a checksum per round; each round's edges are stored, so none depends on lost executors.
    Edges with a null end and loops are ignored.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where((F.col("a") != F.col("b")) & edges["a"].isNotNull() & edges["b"].isNotNull()).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(root.hint("merge"), "a")
        small = met.select("a", F.col("m").alias("b")).unionAll(met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = stored(small.distinct(), "edges")
        after = mark(new)
        now = new
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
