"""Streams: event-time windows, late and repeated events, folding of execution state, sinks.

Every function takes a batch or a streaming DataFrame; the plans are the same, and a stream adds its
watermark.  State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import late_events


def timed(events: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time as a timestamp with its watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(events: DataFrame, column: str, width: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """window_start, keys, n: events per window and key."""
    rows = timed(events, column, delay)
    return rows.groupBy(F.window(column, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sliding(events: DataFrame, column: str, width: str, slide: str, keys: list[str], value: str, delay: str = "10 minutes") -> DataFrame:
    """window_start, keys, n, total per sliding window."""
    rows = timed(events, column, delay)
    grouped = rows.groupBy(F.window(column, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, column: str, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, n: runs of a key's events with no gap as long as ``gap``."""
    rows = timed(events, column, delay)
    grouped = rows.groupBy(key, F.session_window(column, gap)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def once(events: DataFrame, column: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Events without those redelivered within the watermark."""
    rows = timed(events, column, delay)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def execution_states(events: DataFrame) -> DataFrame:
    """execution_id, event_type, sequence, applied: state folded from a stream; events of lower numbers are stale."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, applied, kind = state.get if state.exists else (-1, 0, "")
        for part in parts:
            for row in part.sort_values("sequence").itertuples(index=False):
                if row.sequence > last:
                    last, applied, kind = int(row.sequence), applied + 1, row.event_type
        state.update((last, applied, kind))
        yield pd.DataFrame({"execution_id": [key[0]], "event_type": [kind], "sequence": [last], "applied": [applied]})

    rows = events.where("execution_id is not null and sequence is not null").select("execution_id", "event_type", "sequence")
    return rows.groupBy("execution_id").applyInPandasWithState(
        fold, "execution_id string, event_type string, sequence long, applied long", "sequence long, applied long, event_type string", "update", GroupStateTimeout.NoTimeout
    )


class LateCounts:
    """Sink that keeps late-corrected hour counts of a stream in a folder.

    Each micro-batch adds its events to the log of arrivals and rewrites the counts of the streams it
    touches by merging their counter cells.  A batch that is run again writes the same files: its
    folder is named by its number, and cells that the log holds twice merge to one.
    """

    def __init__(self, folder: str, cut_off_hours: int = 12) -> None:
        self.folder, self.cut_off_hours = folder, cut_off_hours

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/arrivals/batch={number}")
        spark: SparkSession = batch.sparkSession
        log = spark.read.parquet(f"{self.folder}/arrivals").drop("batch")
        touched = batch.select("root_execution_id").distinct()
        fresh = late_events.corrected_hours(log.join(touched, "root_execution_id", "left_semi"), self.cut_off_hours)
        fresh.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")

    def counts(self, spark: SparkSession) -> DataFrame:
        """Counts per stream and hour as of the last batch that touched the stream."""
        rows = spark.read.parquet(f"{self.folder}/counts")
        last = rows.groupBy("root_execution_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["root_execution_id", "batch"], "left_semi").drop("batch")
