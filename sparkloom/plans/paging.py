"""Cursors, limits, aging queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import paging
from sparkloom.plans.registry import events, query, read, seconds

_FILTER = {"and": [{"field": "o_orderstatus", "in": ["O", "F"]}, {"field": "o_totalprice", "gt": 1000}]}
_KEY = paging.fingerprint(_FILTER)
_OTHER = paging.fingerprint({"field": "o_orderstatus", "in": ["O"]})


@query(f"""SELECT o_orderkey, 'b64:' || rtrim(translate(base64(CAST('{{"f":"{_KEY}","o":"desc","s":' || o_orderkey || ',"t":' || o_custkey || '}}' AS BLOB)), '+/', '-_'), '=') AS cursor FROM orders""")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor behind each order."""
    return read(spark, sf_dir, "orders").select("o_orderkey", paging.cursor(F.col("o_orderkey"), "desc", _KEY, F.col("o_custkey")).alias("cursor"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS seq, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS total, CASE o_orderkey % 4 WHEN 1 THEN 'other order' WHEN 2 THEN 'other filter' WHEN 3 THEN 'malformed' END AS error FROM orders""")
def cursor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors read back: those of this walk give their place, those of another filter or order and broken ones an error."""
    key, n = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(key % 4 == 0, paging.cursor(key, "desc", _KEY, n)).when(key % 4 == 1, paging.cursor(key, "asc", _KEY, n)).when(key % 4 == 2, paging.cursor(key, "desc", _OTHER, n)).otherwise(F.concat(F.lit("b64:!"), key.cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", paging.cursor_state(raw, "desc", _KEY).alias("s")).select("o_orderkey", "s.seq", "s.total", "s.error")


@query("""SELECT event_id, 'b64:' || rtrim(translate(base64(CAST(epoch_us(ts) || '|' || event_id AS BLOB)), '+/', '-_'), '=') AS cursor, epoch_us(ts) AS micros, event_id AS id FROM events""")
def time_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opaque cursor of time and id for each event, and what it says when read back."""
    coded = events(spark, sf_dir).select("event_id", paging.time_cursor(F.col("ts"), F.col("event_id")).alias("cursor"))
    return coded.withColumn("s", paging.time_cursor_state(F.col("cursor"))).select("event_id", "cursor", "s.micros", "s.id")


@query("""SELECT o_orderkey, CAST(least(greatest(coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey - 50 END, 20), 1), 200) AS BIGINT) AS page FROM orders""")
def clamped_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") - 50)
    return read(spark, sf_dir, "orders").select("o_orderkey", paging.clamped(asked).cast("long").alias("page"))


@query("""WITH q AS (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS p, epoch(TIMESTAMP '2024-01-31') - epoch_us(ts) / 1e6 AS waited FROM events) SELECT event_id, CAST(greatest(p - floor(greatest(waited, 0.0) / 432000), 0) AS INTEGER) AS priority FROM q""")
def aged_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of waiting events, which rise by one for each five days."""
    kind = F.col("event_type")
    p = F.when(kind == "error", 0).when(kind == "purchase", 1).when(kind == "signup", 2).otherwise(3)
    return events(spark, sf_dir).select("event_id", paging.aged(p, F.lit(1706659200.0) - seconds("ts"), 432_000.0).alias("priority"))


@query("""WITH q AS (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS p, epoch(TIMESTAMP '2024-01-31') - epoch_us(ts) / 1e6 AS waited FROM events) SELECT event_id, CAST(greatest(p - floor(greatest(waited, 0.0) / 432000), 0) AS INTEGER) AS priority FROM q ORDER BY priority, event_id LIMIT 100""")
def next_in_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred events that a queue with aging gives out first."""
    return aged_priorities(spark, sf_dir).orderBy("priority", "event_id").limit(100)
