"""Stored results with a time to live, as a stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EXPIRED = "key string, result string, created_ms long, expired_ms long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiry(StatefulProcessor):
    """Keeps the newest result of each key; when the watermark passes its time to live, emits and forgets it."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("result", "result string, created_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        newest = self.stored.get() if self.stored.exists() else None
        for part in rows:
            for result, created in zip(part["result"], part["created_ms"], strict=True):
                if newest is None or (int(created), result or "") > (newest[1], newest[0] or ""):
                    newest = (result, int(created))
        self.stored.update(newest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest[1] + self.ttl_ms)
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "result": pd.Series([], dtype=object), "created_ms": pd.Series([], dtype="int64"), "expired_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        result, created = self.stored.get()
        self.stored.clear()
        yield pd.DataFrame({"key": [key[0]], "result": [result], "created_ms": [created], "expired_ms": [created + self.ttl_ms]})


def expired_results(results: DataFrame, days: float, late: str = "0 seconds", key: str = "key") -> DataFrame:
    """A stream (key, result, created_at) -> (key, result, created_at, expired_at) of results that have outlived ``days``.

    A newer result of a key takes the place of the older one and starts its time again. Time is the watermark's: what was
    created at most ``late`` behind the newest row. Rows with a null key or time are left out. The session's state store
    must be the one on disk (``ROCKSDB``).
    """
    rows = results.where(F.col(key).isNotNull() & F.col("created_at").isNotNull()).withWatermark("created_at", late)
    keyed = rows.select(F.col(key).cast("string").alias("key"), "result", "created_at", F.unix_millis("created_at").alias("created_ms"))
    out = keyed.groupBy("key").transformWithStateInPandas(Expiry(int(days * 86_400_000)), outputStructType=EXPIRED, outputMode="Update", timeMode="EventTime")
    return out.select("key", "result", F.timestamp_millis("created_ms").alias("created_at"), F.timestamp_millis("expired_ms").alias("expired_at"))
