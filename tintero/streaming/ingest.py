"""Streams: new pages and events from a folder, cleaned, sessionised or aggregated with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tintero.sources import writers

PAGES = "page_id BIGINT, pdf_filename STRING, page INT, text STRING, extracted_at TIMESTAMP"
EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def folder(spark: SparkSession, path: str, schema: str, per_trigger: int = 100, only: str | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive; ``only`` narrows them to a file name or pattern."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", only) if only else reader).parquet(path)


def run_available(stream: DataFrame, target: str, state: str, step: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Everything that has arrived, once: each batch is passed through ``step`` and written under its number."""

    def each(df: DataFrame, n: int) -> None:
        writers.batch(step(df) if step else df, target, n)

    writer = stream.writeStream.outputMode(mode)
    writer.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def append_available(stream: DataFrame, target: str, state: str) -> None:
    stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user that end after a pause; rows later than the watermark are left out of closed sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per type in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def running_totals(events: DataFrame, late: str = "2 hours", idle: str = "7 days") -> DataFrame:
    """Running count and sum per user, kept in state across batches; a user's state goes once the watermark is so far beyond the last event."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        last = None
        for f in frames:
            n += len(f)
            total += float(f["value"].sum())
            if f["ts"].notna().any():
                last = f["ts"].max() if last is None else max(last, f["ts"].max())
        state.update((n, total))
        if last is not None:
            until = int((last + pd.Timedelta(idle)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], n, total)], columns=["user_id", "n", "total"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.EventTimeTimeout)


def latest_updates(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last version of every key from batches of updates written under their numbers."""
    x = spark.read.parquet(target)
    rest = [c for c in x.columns if c not in (*keys, "batch")]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")
