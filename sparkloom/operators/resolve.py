"""Conflicts between replicas, duplicates in time, overlapping spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dominates(a: Column, b: Column) -> Column:
    """Whether vector clock a (map of node to count) is at least b everywhere; missing nodes are 0."""
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.try_element_at(a, e["key"]), F.lit(0)) >= e["value"])


def newer(a: Column, b: Column, clock: str, *ties: str) -> Column:
    """Of two structs the one whose clock dominates (b if they are equal); concurrent ones by the larger `ties`."""
    a_up, b_up = dominates(a[clock], b[clock]), dominates(b[clock], a[clock])
    tie = F.struct(*(b[t] for t in ties)) >= F.struct(*(a[t] for t in ties))
    return F.when(b_up, b).when(a_up, a).when(tie, b).otherwise(a)


def resolved(versions: DataFrame, key: str, clock: str, *ties: str) -> DataFrame:
    """One row a key: versions folded in the order of ties. A key's versions are as many as its replicas."""
    rest = [c for c in versions.columns if c != key]
    ordered = versions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest)), lambda x, y: F.when(F.struct(*(x[t] for t in ties)) < F.struct(*(y[t] for t in ties)), -1).when(F.struct(*(x[t] for t in ties)) > F.struct(*(y[t] for t in ties)), 1).otherwise(0)).alias("_v"))
    best = F.aggregate(F.slice("_v", 2, F.size("_v")), F.element_at("_v", 1), lambda s, x: newer(s, x, clock, *ties))
    return ordered.select(key, best.alias("_b")).select(key, *(F.col("_b").getField(c).alias(c) for c in rest))


def replica_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) where a key is missing on one side or its values differ."""
    both = a.select(key, F.col(value).alias("a"), F.lit(1).alias("_a")).join(b.select(key, F.col(value).alias("b"), F.lit(1).alias("_b")), key, "full")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(key, "a", "b")


def not_repeated(df: DataFrame, keys: list[str], ts: str, within: float, *ties: str) -> DataFrame:
    """Rows that don't follow a row of the same keys within `within` seconds."""
    w = Window.partitionBy(*keys).orderBy(ts, *ties)
    gap = F.col(ts) - F.lag(ts).over(w)
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > within)).drop("_gap")


def passes_ttl(rows: DataFrame, by: list[str], ts: str, order: list[str], ttl: int) -> DataFrame:
    """rows (by, ts) with `passed`: whether a cache lets a row pass, that is the first of a key and each that comes `ttl` or more after
    the last that passed. A fold over sorted rows; ts is a whole number."""
    from sparkloom.operators import ordered

    def step(last, row):  # noqa: ANN001, ANN202
        passed = last is None or row[ts] - last >= ttl
        return (row[ts] if passed else last), (*(row[c] for c in by), row[ts], passed)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*by, ts))
    return ordered.folded(rows, by, order, lambda: None, step, f"{schema}, passed boolean", [ts])


def first_within_ttl(times: Column, ttl: float) -> Column:
    """Of a sorted array of times those that pass a cache: the first, then each that comes `ttl` or more after the last that passed."""
    start = F.array().cast("array<double>")
    return F.aggregate(times, start, lambda s, t: F.when((F.size(s) == 0) | (t - F.element_at(s, -1) >= ttl), F.concat(s, F.array(t))).otherwise(s))


def without_overlaps(spans: Column) -> Column:
    """Spans (struct start, end, ..) sorted by start; one that starts before the last kept end is dropped."""
    first = F.slice(spans, 1, 1)
    return F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), first, lambda s, x: F.when((F.size(s) == 0) | (x["start"] >= F.element_at(s, -1)["end"]), F.concat(s, F.array(x))).otherwise(s))
