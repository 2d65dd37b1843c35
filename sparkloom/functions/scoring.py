"""Scores, weights and classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Syslog ordinals of level names and their aliases.
SEVERITY = {"EMERGENCY": 0, "EMERG": 0, "ALERT": 1, "CRITICAL": 2, "CRIT": 2, "FATAL": 2, "ERROR": 3, "ERR": 3, "WARNING": 4, "WARN": 4, "NOTICE": 5, "INFO": 6, "DEBUG": 7, "TRACE": 7}


def severity(name: Column) -> Column:
    """Syslog ordinal of a level name; 7 (debug) for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(name))), F.lit(7))


def level_of_status(status: Column) -> Column:
    return F.when(status < 400, "INFO").when(status < 500, "WARN").otherwise("ERROR")


def proximity(a: Column, b: Column, span: int) -> Column:
    """1 for equal ranks, 0 for ranks `span` apart."""
    return F.lit(1.0) - F.abs(a - b) / F.lit(float(span))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def half_life(age: Column, life: float) -> Column:
    """0.5 ** (age / life), negative ages as 0."""
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / life)


def cosine(a: Column, b: Column) -> Column:
    """Of two maps of counts; 0 if either has no length."""
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    both = norm(a) * norm(b)
    return F.when(both > 0, dot / both).otherwise(0.0)


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the mod-10 check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))
    return F.coalesce(digits.rlike(r"^[0-9]{13,19}$") & (total % 10 == 0), F.lit(False))


def md5_mod(key: Column, n: int) -> Column:
    """The 128-bit md5 of a text modulo n. conv() has 64 bits, so the halves are taken apart."""
    hexed = F.md5(key.cast("binary"))
    half = lambda at: F.conv(F.substring(hexed, at, 16), 16, 10).cast("decimal(20,0)") % n
    return ((half(1) * (2**64 % n) + half(17)) % n).cast("int")
