"""The serving rules as Structured Streaming queries.

They need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``) where they use
``transformWithStateInPandas``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RateLimiter(StatefulProcessor):
    """Counts a user's events in windows that begin with the first event after the last window."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.micros = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "n int, reset long")

    def handleInputRows(self, key, rows, timerValues):
        state = self.bucket.get() if self.bucket.exists() else None
        n, reset = (state[0], state[1]) if state else (0, None)
        table = pd.concat(list(rows)).sort_values(["t", "event_id"])
        out = []
        for t, event in zip(table["t"], table["event_id"], strict=True):
            n, reset = (1, int(t) + self.micros) if reset is None or reset < t else (n + 1, reset)
            out.append((int(key[0]), int(t), int(event), n, n <= self.limit))
        self.bucket.update((n, reset))
        yield pd.DataFrame(out, columns=["user_id", "t", "event_id", "n", "accepted"])

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """Events with their place in the user's window and whether they are accepted."""
    e = stream.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return e.groupBy("user_id").transformWithStateInPandas(
        RateLimiter(limit, seconds), outputStructType="user_id long, t long, event_id long, n int, accepted boolean", outputMode="Append", timeMode="None"
    )


def scored_once(stream: DataFrame, key: list[str], ts: str = "ts", horizon: str = "30 minutes") -> DataFrame:
    """The first event of each key within the horizon: later ones are cache hits and drop out."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(key)


def bursts(stream: DataFrame, key: str, ts: str = "ts", gap: str = "50 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Events of a key without a pause of the gap, counted when they can no longer grow."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("burst")).agg(F.count("*").alias("n"))
