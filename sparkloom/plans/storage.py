"""Stores in several formats: written, migrated, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import delta
from sparkloom.plans.registry import events, query, read
from sparkloom.sources import files
from sparkloom.streaming.engine import shared_dir


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/store-{name}-{uuid.uuid4().hex}"


_ROWS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _round_trip(spark: SparkSession, sf_dir: str, format_: str) -> DataFrame:
    rows, path = read(spark, sf_dir, "customer"), _place(spark, format_)
    files.write(rows, path, format_, rows_per_file=500)
    schema = None if format_ in ("parquet", "orc") else "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return files.read(spark, path, format_, schema).select(*rows.columns)


@query(_ROWS)
def json_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "json")


@query(_ROWS)
def csv_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv")


@query(_ROWS)
def xml_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "xml")


@query(_ROWS)
def orc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "orc")


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def partitioned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store partitioned by a hot field: the filter prunes folders."""
    path = _place(spark, "partitioned")
    files.write(read(spark, sf_dir, "customer"), path, "parquet", partition_by=["c_mktsegment"])
    return files.read(spark, path, "parquet").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type, user_id, CAST(NULL AS VARCHAR) AS missing FROM events""")
def hybrid_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed rows in columns, recent ones in rows, read as one; a column that no part has is null."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id", "ts")
    old, recent = files.seal(rows, "event_id", rows.sparkSession.range(1).count() * 5000)
    a, b = _place(spark, "sealed"), _place(spark, "recent")
    files.write(old.drop("ts"), a, "parquet")
    files.write(recent.drop("ts"), b, "json")
    out = files.read_mixed(spark, [(a, "parquet"), (b, "json")], ["event_id", "event_type", "user_id", "missing"])
    return out.withColumn("missing", F.col("missing").cast("string"))


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def migrated_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _place(spark, "from"), _place(spark, "to")
    files.write(read(spark, sf_dir, "supplier"), source, "json")
    return files.migrate(spark, source, "json", target, "parquet", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("""SELECT event_id, user_id, event_type AS type, CAST(value AS VARCHAR) AS v FROM events""")
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows encoded as keyframes and deltas, decoded by a fold over each segment."""
    rows = events(spark, sf_dir).select("user_id", "event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("v"), F.col("value").cast("string")).alias("fields"))
    back = delta.decode(delta.encode(rows, "user_id", "event_id", "fields", 16), "user_id", "event_id")
    return back.select("event_id", "user_id", F.try_element_at("fields", F.lit("type")).alias("type"), F.try_element_at("fields", F.lit("v")).alias("v"))


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2""")
def pushed_down_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name", "n_regionkey")
