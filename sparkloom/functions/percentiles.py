"""The percentile rules that differ between log tools, one function each. All are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(value: Column, p: float) -> Column:
    """Interpolated between the two nearest ranks."""
    return F.percentile(value, p / 100)


def nearest_rank(value: str, p: float) -> Column:
    """The value at rank ceil(p/100 * n); 0 without values. value is an SQL expression."""
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def index_rule(value: Column, p: float) -> Column:
    """sorted[int(n * p / 100)], the last value at most."""
    values = F.sort_array(F.collect_list(value))
    return F.try_element_at(values, F.least(F.floor(F.size(values) * p / 100).cast("int") + 1, F.size(values)))


def floor_rank(value: Column, p: float) -> Column:
    """sorted[floor(p / 100 * (n - 1))]."""
    values = F.sort_array(F.collect_list(value))
    return F.try_element_at(values, F.floor((F.size(values) - 1) * p / 100).cast("int") + 1)
