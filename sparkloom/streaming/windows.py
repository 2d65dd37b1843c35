"""Streaming windows, sessions, de-duplication and routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """With event time and a watermark; times in the tables carry no zone and are UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(stream: DataFrame, size: str, by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Counts, errors, sums and extremes of `value` by window and keys."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    v = F.col("value")
    out = stream.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), *by, "n", "errors", F.round("total", 4).alias("total"), "least", "most")


def sessions(stream: DataFrame, by: str, gap: str) -> DataFrame:
    """Sessions by inactivity alone."""
    out = stream.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(by, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n", F.round("total", 4).alias("total"))


def deduplicated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def routed(batch: DataFrame, routes: dict[str, Column], write: Callable[[str, DataFrame], None]) -> None:
    """Send each row to the first route whose condition holds, else to dead_letter."""
    topic = None
    for name, fits in routes.items():
        topic = F.when(fits, name) if topic is None else topic.when(fits, name)
    named = batch.withColumn("_route", F.coalesce(topic, F.lit("dead_letter")))
    for name in (*routes, "dead_letter"):
        write(name, named.where(F.col("_route") == name).drop("_route"))


class Alerts:
    """Thresholds with a cooldown: critical before warning; a key is silent for `cooldown` seconds after an alert."""

    def __init__(self, warning: float, critical: float, cooldown: float):
        self.warning, self.critical, self.cooldown, self.last = warning, critical, cooldown, {}

    def check(self, key: str, value: float, now: float) -> str | None:
        level = "critical" if value >= self.critical else "warning" if value >= self.warning else None
        if level is None or now - self.last.get((key, level), float("-inf")) < self.cooldown:
            return None
        self.last[key, level] = now
        return level
