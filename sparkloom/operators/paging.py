"""Positions in a walk over pages: fingerprints of filters, cursors, limits, queues."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "b64:"
LIMIT_DEFAULT, LIMIT_MAX = 20, 200


def canonical(tree: object) -> object:
    """A filter tree whose order doesn't matter: the parts of `and` and `or` and the values of `in` are sorted."""
    if isinstance(tree, Mapping):
        return {k: sorted((canonical(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True)) if k in ("and", "or", "in") else canonical(v) for k, v in tree.items()}
    if isinstance(tree, Sequence) and not isinstance(tree, str):
        return [canonical(x) for x in tree]
    return tree


def fingerprint(tree: object) -> str:
    """16 hexadecimal digits that are equal for filters that differ only in the order of their parts; also a key for cached queries."""
    return hashlib.sha256(json.dumps(canonical(tree), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def _opaque(payload: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.rtrim(F.translate(F.base64(payload.cast("binary")), "+/\r\n", "-_"), F.lit("=")))


def _opened(cursor: Column) -> Column:
    """The payload of a cursor; null if it is none."""
    body = F.substring(cursor, len(PREFIX) + 1, 1 << 20)
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    fits = cursor.startswith(PREFIX) & body.rlike("^[A-Za-z0-9_-]+$")
    return F.when(fits, F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8"))


def cursor(seq: Column, order: str, filter_: str, total: Column) -> Column:
    """The place behind row `seq` of a walk in one order over what one filter (its fingerprint) lets through."""
    return _opaque(F.to_json(F.struct(F.lit(filter_).alias("f"), F.lit(order).alias("o"), seq.alias("s"), total.alias("t"))))


def cursor_state(raw: Column, order: str, filter_: str) -> Column:
    """Struct (seq, total, error): error says what is wrong with a cursor for this walk, else it is null."""
    parsed = F.from_json(_opened(raw), "f string, o string, s long, t long")
    error = (
        F.when(parsed.isNull() | parsed["f"].isNull() | parsed["o"].isNull() | parsed["s"].isNull() | parsed["t"].isNull(), "malformed")
        .when(parsed["f"] != filter_, "other filter")
        .when(parsed["o"] != order, "other order")
    )
    good = error.isNull()
    return F.struct(F.when(good, parsed["s"]).alias("seq"), F.when(good, parsed["t"]).alias("total"), error.alias("error"))


def time_cursor(ts: Column, id_: Column) -> Column:
    """An opaque place in the order of (time, id): microseconds and id."""
    return _opaque(F.concat_ws("|", F.unix_micros(ts.cast("timestamp")).cast("string"), id_.cast("string")))


def time_cursor_state(raw: Column) -> Column:
    """Struct (micros, id), both null for what is no cursor."""
    parts = F.split(_opened(raw), r"\|")
    return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("long").alias("micros"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("id"))


def clamped(limit: Column, default: int = LIMIT_DEFAULT, most: int = LIMIT_MAX) -> Column:
    """A page size between 1 and most; the default for null."""
    return F.least(F.greatest(F.coalesce(limit, F.lit(default)), F.lit(1)), F.lit(most))


def aged(priority: Column, waited: Column, threshold: float) -> Column:
    """A priority (0 is the highest) that rises by one for each `threshold` seconds of waiting."""
    return F.greatest(priority - F.floor(F.greatest(waited, F.lit(0.0)) / threshold), F.lit(0)).cast("int")
