"""Keyed lookups, nearest-event joins and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by `order`, ties by the following names. A pre-aggregated max of structs:
    a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("best"))
    return best.select(key, "best.*").select(*df.columns)


def grouped_by_key(keys: DataFrame, rows: DataFrame, key: str, value: Column, order: list[Column], most: int) -> DataFrame:
    """(key, values): up to `most` values for each requested key, in order; an empty list for a key without rows."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    kept = rows.where(F.col(key).isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= most)
    lists = kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", value.alias("_v")))), lambda s: s["_v"]).alias("values"))
    return keys.select(key).distinct().join(lists, key, "left").withColumn("values", F.coalesce("values", F.array().cast(lists.schema["values"].dataType)))


def nearest(left: DataFrame, right: DataFrame, ts: str, left_id: str, right_id: str, by: str, most: float, buckets: float | None = None) -> DataFrame:
    """For each left row the right row of the same `by` value nearest in time: (left_id, right_id, distance), at most
    `most` seconds away; the earlier wins only if strictly nearer, equal times by the smaller id.

    ts is in seconds. Each row is placed in time buckets `most` wide; a left row meets the rights of its own and the two
    neighbouring buckets, so the join is an equi-join on (by, bucket) whose groups hold a time window, whatever the
    number of rows a key has.
    """
    width = float(buckets or most or 1)
    l = left.select(F.col(by).alias("_by"), F.col(left_id).alias("_l"), F.col(ts).alias("_lt"))
    r = right.select(F.col(by).alias("_by"), F.col(right_id).alias("_r"), F.col(ts).alias("_rt"))
    near = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: (F.floor(F.col("_lt") / width) + d).cast("long")))
    pairs = l.withColumn("_b", near).join(r.withColumn("_b", F.floor(F.col("_rt") / width).cast("long")), ["_by", "_b"])
    gap = F.abs(F.col("_rt") - F.col("_lt"))
    best = pairs.where(gap <= most).groupBy("_l").agg(F.min(F.struct(gap.alias("distance"), (F.col("_rt") < F.col("_lt")).alias("earlier"), F.col("_r").alias("r"))).alias("m"))
    return best.select(F.col("_l").alias(left_id), F.col("m.r").alias(right_id + "_near"), F.col("m.distance").alias("distance"))


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before each row's time, by a union and one window: no pairs are made."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    other = right.select(by, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    window = Window.partitionBy(by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.unionByName(other, allowMissingColumns=True).withColumn(f"{value}_as_of", F.last("_v", ignorenulls=True).over(window))
    return filled.where("_side = 1").select(*left.columns, f"{value}_as_of")


def within(left: DataFrame, right: DataFrame, seconds: float, ts: str) -> DataFrame:
    """Pairs (l, r) of structs with 0 <= r.ts - l.ts <= seconds, by buckets of that width: r's bucket is l's or the next."""
    l = left.select(F.struct("*").alias("l"), F.explode(F.array(F.floor(F.col(ts) / seconds), F.floor(F.col(ts) / seconds) + 1)).alias("_b"))
    r = right.select(F.struct("*").alias("r"), F.floor(F.col(ts) / seconds).alias("_b"))
    gap = F.col(f"r.{ts}") - F.col(f"l.{ts}")
    return l.join(r, "_b").where((gap >= 0) & (gap <= seconds)).select("l", "r")
