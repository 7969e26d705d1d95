"""Findings and events as streams: windows over event time with late rows, and merges of scans as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import merge


def windowed(events: DataFrame, every: str = "1 day", slide: str | None = None, late: str = "1 day", time: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, end, by, n, total) of windows over event time; rows later than `late` behind the newest are left out. events: a stream or a table with value."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = rows.groupBy(F.window(time, every, slide) if slide else F.window(time, every), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", time: str = "ts", by: str = "user_id") -> DataFrame:
    """(start, end, by, n): stretches of events of one key with no gap that long."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def merging(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], **options) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a scan that is merged into the state. read gives the state, write keeps the next one under the batch's number, so that a batch done again overwrites itself."""

    def step(scan: DataFrame, number: int) -> None:
        after = merge.merge(read(), scan, **options).drop("change")
        write(after, number)

    return step
