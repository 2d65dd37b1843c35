"""Registries of map, reduce and post-processing functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAPS: dict[str, Callable[[DataFrame], DataFrame]] = {}
REDUCES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda v: F.sum(v.cast("double")),
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "collect": lambda v: F.to_json(F.array_sort(F.collect_set(v))),
}
POST: dict[str, Callable[[DataFrame], DataFrame]] = {}


def map_function(name: str) -> Callable:
    """Register a function from rows to a DataFrame of (k, v) pairs."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        MAPS[name] = f
        return f

    return add


def python_map(name: str, schema: str = "k string, v double") -> Callable:
    """Register a Python function from a row (dict) to pairs; it runs in Arrow batches."""

    def add(f: Callable[[dict], Iterator[tuple]]) -> Callable:
        def run(df: DataFrame) -> DataFrame:
            def batches(frames):  # noqa: ANN001, ANN202
                import pyarrow as pa

                for b in frames:
                    pairs = [p for row in b.to_pylist() for p in f(row)]
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], names=["k", "v"])

            return df.mapInArrow(batches, schema)

        MAPS[name] = run
        return f

    return add


def reduce_function(name: str) -> Callable:
    """Register an aggregate: a function from the column of values to a Column."""

    def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        REDUCES[name] = f
        return f

    return add


def post_process(name: str) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        POST[name] = f
        return f

    return add


def run(df: DataFrame, map_name: str, reduce_name: str, post: str | None = None) -> DataFrame:
    """Map, shuffle and reduce; Spark combines on the map side, once, by the aggregate's own algebra."""
    out = MAPS[map_name](df).groupBy("k").agg(REDUCES[reduce_name](F.col("v")).alias("v"))
    return POST[post](out) if post else out


def analyzers() -> dict[str, list[str]]:
    return {"map": sorted(MAPS), "reduce": sorted(REDUCES), "post": sorted(POST)}


@map_function("count_by_type")
def _count_by_type(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_type").alias("k"), F.lit(1.0).alias("v"))


@map_function("words")
def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w{3,}"), F.lit(0))).alias("k"), F.lit(1.0).alias("v"))
