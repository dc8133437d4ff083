"""Structured Streaming: windowed counts, sessions, deduplication, rate limits, ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) counted by window; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, minutes: int = DEFAULTS.session_ttl_minutes, late: str = "2 hours") -> DataFrame:
    """Sessions of a user that end after the time to live without an event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first of the events of an id that arrive within the watermark of each other."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rate_limited(requests: DataFrame, rate: float = DEFAULTS.rate_per_second, burst: float = DEFAULTS.rate_burst) -> DataFrame:
    """Requests (key, seq, at in seconds) -> key, seq, allowed; each key's bucket is its state."""

    def consume(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        allowed = []
        for at in rows["at"]:
            tokens = min(burst, tokens + (0.0 if last is None else max(0.0, at - last)) * rate)
            last = at if last is None else max(last, at)
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "allowed": allowed})

    return requests.groupBy("key").applyInPandasWithState(consume, "key string, seq long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def ingest_files(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Takes in every file of a folder that is new since the last call: path, size, sha-256, whether it is a PDF.

    The checkpoint remembers what was read, so a run that broke off goes on where it was.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select("path", "length", F.sha2("content", 256).alias("content_hash"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
