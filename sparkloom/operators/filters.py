"""Structured filters and boolean search trees as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.logic import contains

MAX_DEPTH = 8
MAX_VALUES = 64
_ORDER = ("gt", "gte", "lt", "lte")
OPS = ("eq", "ne", "in", "nin", "contains", *_ORDER)


def leaf(field: str, op: str, value: object, ordinals: Mapping[str, Mapping[str, int]] | None = None) -> Column:
    """One comparison. Null matches only ne and nin. A field with ordinals (such as level) is ordered by them."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    c = F.col(field)
    if op in ("in", "nin"):
        if not isinstance(value, Sequence) or isinstance(value, str) or not 1 <= len(value) <= MAX_VALUES:
            raise ValueError(f"{op} needs 1 to {MAX_VALUES} values")
        hit = F.coalesce(c.isin(*value), F.lit(False))
        return ~hit if op == "nin" else hit
    if op == "contains":
        return contains(c, str(value))
    if op in _ORDER and ordinals and field in ordinals:
        known = F.create_map(*[F.lit(x) for kv in ordinals[field].items() for x in kv])
        c, value = F.try_element_at(known, c), ordinals[field][value]
    v = F.lit(value)
    if op == "ne":
        return c.isNull() | (c != v)
    hit = {"eq": c == v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    return F.coalesce(hit, F.lit(False))


def tree(node: Mapping, ordinals: Mapping[str, Mapping[str, int]] | None = None, depth: int = 0) -> Column:
    """{"all": [..]}, {"any": [..]}, {"not": node} or {"field", "op", "value"}; an empty all is true, an empty any false."""
    if depth > MAX_DEPTH:
        raise ValueError("the tree is too deep")
    if "all" in node:
        return reduce(lambda a, b: a & b, (tree(n, ordinals, depth + 1) for n in node["all"]), F.lit(True))
    if "any" in node:
        return reduce(lambda a, b: a | b, (tree(n, ordinals, depth + 1) for n in node["any"]), F.lit(False))
    if "not" in node:
        return ~tree(node["not"], ordinals, depth + 1)
    return leaf(node["field"], node["op"], node["value"], ordinals)


def time_of_day(ts: Column, low: str, high: str) -> Column:
    """Inclusive HH:MM range; it wraps midnight if low > high."""
    t = F.date_format(ts, "HH:mm")
    return t.between(low, high) if low <= high else (t >= low) | (t <= high)


def facet_filter(selected: Mapping[str, Sequence[str]], skip: str | None = None) -> Column:
    """OR within a dimension, AND across dimensions; `skip` leaves one dimension out."""
    return reduce(lambda a, b: a & b, (F.col(k).isin(*v) for k, v in selected.items() if v and k != skip), F.lit(True))


def facets(df: DataFrame, dimensions: Sequence[str], selected: Mapping[str, Sequence[str]], top: int = 10) -> DataFrame:
    """(dimension, value, n): counts of each dimension under the filters of the others, the `top` largest with ties by value,
    and selected values even at 0. All dimensions are counted in one pass over the rows."""
    from pyspark.sql import Window

    pairs = F.explode(F.filter(F.array(*(F.when(facet_filter(selected, d), F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))) for d in dimensions)), lambda x: x.isNotNull()))
    counted = df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    chosen = [(d, v) for d in dimensions for v in selected.get(d, ())]
    if chosen:
        zero = df.sparkSession.createDataFrame([(d, v, 0) for d, v in chosen], "dimension string, value string, n long")
        counted = counted.unionByName(zero).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    keep = reduce(lambda a, b: a | b, ((F.col("dimension") == d) & (F.col("value") == v) for d, v in chosen), F.lit(False))
    return counted.withColumn("rank", rank).where((F.col("rank") <= top) | keep).select("dimension", "value", "n")


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """The page after a cursor, newest first, with one row more if there is a next page. The keys together must be unique."""
    if after is not None:
        smaller = F.lit(False)
        equal = F.lit(True)
        for k, v in zip(keys, after, strict=True):
            smaller = smaller | (equal & (F.col(k) < F.lit(v)))
            equal = equal & (F.col(k) == F.lit(v))
        df = df.where(smaller)
    return df.orderBy(*(F.desc(k) for k in keys)).limit(limit + 1)
