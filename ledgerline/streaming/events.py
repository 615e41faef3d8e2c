"""Streaming twins of the batch operators over an event stream (event_id, ts, user_id, event_type, value, props).

Event time must be a timestamp with zone; `from_files` casts it. All state is bounded by a
watermark, so late rows are dropped as the batch operators exclude rows of unknown time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def from_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files under path as a stream; ts becomes a UTC timestamp."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total of tumbling windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """user_id, start, stop, n of sessions closed by a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first of rows with equal keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _detect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean, up, down, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, -(10**15))
    out = []
    # a key's rows of one batch may come in several frames that aren't in order among themselves
    held = [rows for rows in frames if len(rows)]
    if held:
        rows = pd.concat(held).sort_values(["ts", "event_id"])
        for ts, x, event_id in zip(rows["ts"], np.log1p(rows["value"].to_numpy()), rows["event_id"], strict=True):
            n += 1
            mean += (x - mean) / n
            up, down = max(0.0, up + x - mean - 0.05), max(0.0, down - x + mean - 0.05)
            second = int(pd.Timestamp(ts).timestamp())
            if max(up, down) > 5.0:
                if second - last >= 6 * 3600:
                    out.append((key[0], ts, event_id, max(up, down)))
                    last = second
                n, mean, up, down = 0, 0.0, 0.0, 0.0
    state.update((n, mean, up, down, last))
    if out:
        yield pd.DataFrame(out, columns=["event_type", "ts", "event_id", "score"])


def alarms(events: DataFrame, late: str = "2 days") -> DataFrame:
    """event_type, ts, event_id, score: Page-Hinkley per event type with six hours between alarms; state is five numbers a key."""
    return events.withWatermark("ts", late).groupBy("event_type").applyInPandasWithState(_detect, "event_type string, ts timestamp, event_id long, score double", "n long, mean double, up double, down double, last long", "append", GroupStateTimeout.NoTimeout)


def top_per_window(batch: DataFrame, k: int = 3) -> DataFrame:
    """The k largest windows of one micro-batch, for foreachBatch: a later batch can't displace them."""
    from ledgerline.operators.windows import top

    return top(batch, ["start"], [F.desc("total"), F.asc("event_type")], k)
