"""Sketches: approximate frequencies, Bloom membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(key: Column, depth: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), F.pmod(F.xxhash64(key, i), F.lit(width)).alias("cell")))


def count_min(df: DataFrame, key: str, depth: int = 5, width: int = 1 << 16) -> DataFrame:
    """(row, cell, n): a count-min table of at most depth * width rows, pre-aggregated; tables add up over parts."""
    return df.select(F.explode(_cells(F.col(key), depth, width)).alias("c")).groupBy("c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def frequencies(df: DataFrame, key: str, depth: int = 5, width: int = 1 << 16) -> DataFrame:
    """(key, estimate): never below the true count."""
    keys = df.select(key).distinct()
    asked = keys.select(key, F.explode(_cells(F.col(key), depth, width)).alias("c")).select(key, "c.row", "c.cell")
    return asked.join(count_min(df, key, depth, width), ["row", "cell"]).groupBy(key).agg(F.min("n").alias("estimate"))


def bloom_bits(items: int, false_positives: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter."""
    bits = max(64, math.ceil(-items * math.log(false_positives) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(items, 1) * math.log(2)))


def bloom_filter(df: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the filter as 32-bit words, at most bits / 32 rows; filters of parts are united by bit_or."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(F.col(key), i), F.lit(bits))))
    return df.select(at.alias("b")).groupBy(F.floor(F.col("b") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("mask"))


def maybe_members(df: DataFrame, key: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows whose key may be in the filter: none that is in it is lost."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(F.col(key), i), F.lit(bits))))
    keys = df.select(key).distinct().select(key, at.alias("b"))
    hit = keys.withColumn("word", F.floor(F.col("b") / 32)).join(words, "word").where(F.expr("(shiftright(mask, cast(b % 32 as int)) & 1) = 1"))
    found = hit.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == hashes).select(key)
    return df.join(found, key, "left_semi")
