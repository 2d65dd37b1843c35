"""Comparisons with the log dialect's two truth values: a comparison with null is false, its negation true."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(op: str, left: Column, right: Column) -> Column:
    """False where either side is null, also for !=."""
    return F.coalesce(_OPS[op](left, right), F.lit(False))


def loose(op: str, left: Column, value: object) -> Column:
    """compare() with a literal; against a number a text column is read as a number, unreadable text is no match."""
    if isinstance(value, int | float) and not isinstance(value, bool):
        left = left.try_cast("double")
    return compare(op, left, F.lit(value))


def is_in(left: Column, values: Sequence) -> Column:
    return F.coalesce(left.isin(*values), F.lit(False)) if values else F.lit(False)


def between(left: Column, low: object, high: object) -> Column:
    return loose(">=", left, low) & loose("<=", left, high)


def contains(left: Column, text: str) -> Column:
    """Case-insensitive; no pattern characters."""
    return F.coalesce(F.contains(F.lower(left), F.lit(text.lower())), F.lit(False))
