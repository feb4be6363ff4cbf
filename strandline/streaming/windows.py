"""Event-time windows, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_metrics(events: DataFrame, length: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests and mean latency of each window that an event falls in.

    On a stream, rows later than ``late`` behind the newest are dropped and closed windows leave the state.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    found = marked.groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n"), F.avg("latency").alias("mean_latency"))
    return found.select(F.col("window.start").alias("start"), "n", F.round("mean_latency", 4).alias("mean_latency"))


def first_of_each(stream: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key that arrives; a stream remembers keys as long as its watermark asks."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
