"""Time series: rolling scores, trends, smoothing, seasonality, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_z(value: str, by: str, *order: str, window: int = 100, population: bool = False) -> Column:
    """Score against the `window` rows before, the row itself left out; null with fewer than 2 or without spread."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-window, -1)
    std = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    return F.when((F.count(value).over(w) >= 2) & (std > 1e-9), (F.col(value) - F.avg(value).over(w)) / std)


def moving_average(value: str, by: str, *order: str, window: int) -> Column:
    """Null until the window is full."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - window, 0)
    return F.when(F.count(value).over(w) == window, F.avg(value).over(w))


def rolling_std(value: str, by: str, *order: str, window: int) -> Column:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - window, 0)
    return F.when(F.count(value).over(w) == window, F.stddev_samp(value).over(w))


def lags(value: str, by: str, *order: str, steps: tuple[int, ...]) -> dict[str, Column]:
    w = Window.partitionBy(by).orderBy(*order)
    return {f"lag_{k}": F.lag(value, k).over(w) for k in steps}


def smoothed(values: Column, alpha: float) -> Column:
    """The exponentially weighted mean of an ordered array; null if it's empty."""
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda s, x: s * (1 - alpha) + x * alpha))


def holt(values: Column, alpha: float, beta: float, steps: int) -> Column:
    """Level and slope of an ordered array (two values or more), carried on for `steps`; never below 0."""
    start = F.struct(F.element_at(values, 1).alias("level"), (F.element_at(values, 2) - F.element_at(values, 1)).alias("slope"))

    def step(s: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (s["level"] + s["slope"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["slope"]).alias("slope"))

    end = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)
    return F.when(F.size(values) >= 2, F.greatest(end["level"] + steps * end["slope"], F.lit(0.0)))


def sessions(df: DataFrame, by: str, ts: str, gap: float, *ties: str) -> DataFrame:
    """df with `session`, a number from 1 for each run of rows of a key whose gaps are at most `gap` seconds."""
    w = Window.partitionBy(by).orderBy(ts, *ties)
    new = F.when(F.coalesce(F.col(ts) - F.lag(ts).over(w) > gap, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def histogram(df: DataFrame, seconds: Column, width: int, most: int = 0) -> DataFrame:
    """(bucket, n) with empty buckets as 0. With `most`, k neighbours are folded into one, k the smallest that gives at
    most `most` buckets. One row of bounds decides; the axis is generated, not collected."""
    counted = df.select((F.floor(seconds / width)).alias("b")).where("b is not null").groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    bounds = counted.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    fold = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / most), F.lit(1)) if most else F.lit(1)
    folded = bounds.select("lo", "hi", fold.cast("long").alias("k"))
    axis = folded.where("lo is not null").select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / F.col("k")))).alias("i"), "lo")
    placed = counted.crossJoin(F.broadcast(folded)).select(F.floor((F.col("b") - F.col("lo")) / F.col("k")).alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n"))
    return axis.join(placed, "i", "left").select(((F.col("lo") + F.col("i") * F.col("k")) * width).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def autocorrelation(df: DataFrame, index: str, value: str, lag_from: int, lag_to: int) -> DataFrame:
    """(lag, r) of a regular series with a dense integer index: an equi-join on index - lag for each lag."""
    mean = df.agg(F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("total"))
    x = df.select(F.col(index).alias("i"), F.col(value).alias("x")).crossJoin(F.broadcast(mean)).select("i", (F.col("x") - F.col("m")).alias("x"), "total")
    shifted = x.select(F.explode(F.sequence(F.lit(lag_from), F.lit(lag_to))).alias("lag"), (F.col("i")).alias("j"), F.col("x").alias("y")).withColumn("i", F.col("j") + F.col("lag"))
    return x.join(shifted, "i").groupBy("lag").agg((F.sum(F.col("x") * F.col("y")) / F.max("total")).alias("r"))
