"""Small helpers that several operators use: shared scratch tables and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENT = 200_000  # rows that are broadcast
TEXTS_OF_TASK = 100_000  # that one task derives rows from, where it sorts them


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``).

    Only where the session has no such folder (local tests) is one made in the temp folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(small: DataFrame) -> DataFrame:
    """A stored table of keys for a join, by its counted rows: broadcast up to ``SENT``, else merged."""
    return F.broadcast(small) if small.count() <= SENT else small.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of a scan that has fewer partitions than the cluster has cores, before costly work on each row.

    Larger tables have enough partitions by themselves and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def dealt(rows: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys into a task for every ``TEXTS_OF_TASK`` of the texts they stem from, and one per core at least.

    The texts are only counted. What a task sorts then stays the same however many there are; the session's number of
    partitions does not grow with them, and well compressed rows are merged into few large tasks.
    """
    spark = rows.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, -(-texts.count() // TEXTS_OF_TASK))
    return rows.repartition(wanted, *keys)


def boxed(df: DataFrame) -> Column:
    """All columns of a table as one struct, so that columns of any name can stand beside it (``select("doc.*")`` opens it)."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("doc")


def _range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in range partitions, stored, with each one's partition (__part) and position in it (__pos)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__id"))
    return stored(placed, "rank").select("*", F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"))


def _offsets(parts: DataFrame, amount: Column) -> DataFrame:
    """(__part, __before): the total of the amount in all partitions before each one; as many rows as partitions."""
    counts = parts.groupBy("__part").agg(amount.alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a dense 0-based position over a total order without one task seeing all rows.

    Range partitions are sorted and numbered on their own; the offsets come from one count per partition.
    """
    parts = _range_sorted(df, order)
    offsets = _offsets(parts, F.count("*"))
    return parts.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__before") + F.col("__pos")).alias(name))


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the total of a column over all rows before each one in a total order, summed by range partitions."""
    parts = _range_sorted(df, order)
    offsets = _offsets(parts, F.sum(value))
    inside = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(name))
