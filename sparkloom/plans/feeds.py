"""Binary formats, feeds and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import compliance
from sparkloom.plans.registry import events, query, read, seconds
from sparkloom.sources import binary, feeds

_EVENT = "event_id long, user_id long, event_type string, value double"
_NUMBERS = {"event_id": 1, "user_id": 2, "event_type": 5, "value": 16}


@query("""SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS s_acctbal FROM supplier""")
def avro_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as Avro containers and read back."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("s_acctbal"))
    return binary.from_avro(binary.to_avro(rows), rows.schema)


@query("""SELECT c_name, c_custkey, CAST(NULL AS VARCHAR) AS c_phone_type FROM customer""")
def avro_other_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's schema that has fewer fields than the writer's, in another order, and a new one."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return binary.from_avro(binary.to_avro(rows), "c_name string, c_custkey long, c_phone_type string")


@query("""SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events""")
def protobuf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as Protobuf messages and read back; what isn't set is null."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"))
    return binary.from_proto(binary.to_proto(rows, _NUMBERS), _EVENT, _NUMBERS)


@query("""WITH h AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, max(event_id) + 1 AS high, max(event_id) FILTER (WHERE value < 30) AS done FROM events GROUP BY 1, 2) SELECT topic, partition, CASE WHEN partition = 3 THEN high ELSE greatest(high - coalesce(done, 0), 0) END AS lag FROM h""")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each partition's reader is behind; the last partition has never been read."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), "event_id", "value")
    high = rows.groupBy("topic", "partition").agg((F.max("event_id") + 1).alias("offset"))
    committed = rows.where("value < 30 AND partition < 3").groupBy("topic", "partition").agg(F.max("event_id").alias("offset"))
    return feeds.lag(high, committed)


_ACTIONS = """WITH a AS (SELECT user_id AS actor, CASE WHEN value >= 60 THEN 'failure' WHEN value >= 50 THEN 'denied' ELSE 'success' END AS outcome, epoch_us(ts) / 1e6 AS t, CASE event_type WHEN 'view' THEN CASE user_id % 3 WHEN 0 THEN 'card_access' WHEN 1 THEN 'phi_access' ELSE 'dsr_request' END WHEN 'signup' THEN CASE user_id % 2 WHEN 0 THEN 'card_login' ELSE 'admin_login' END WHEN 'purchase' THEN 'key_rotation' WHEN 'error' THEN CASE user_id % 4 WHEN 0 THEN 'sod_violation' WHEN 1 THEN 'breach_event' ELSE 'breach_notification' END ELSE 'other' END AS action FROM events)"""
_NOW = 1709251200.0


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, kind = F.col("user_id"), F.col("value"), F.col("event_type")
    action = (
        F.when(kind == "view", F.when(u % 3 == 0, "card_access").when(u % 3 == 1, "phi_access").otherwise("dsr_request"))
        .when(kind == "signup", F.when(u % 2 == 0, "card_login").otherwise("admin_login"))
        .when(kind == "purchase", "key_rotation")
        .when(kind == "error", F.when(u % 4 == 0, "sod_violation").when(u % 4 == 1, "breach_event").otherwise("breach_notification"))
        .otherwise("other")
    )
    return events(spark, sf_dir).select(u.alias("actor"), F.when(v >= 60, "failure").when(v >= 50, "denied").otherwise("success").alias("outcome"), seconds("ts").alias("t"), action.alias("action"))


@query(_ACTIONS + """ SELECT count(DISTINCT actor) FILTER (WHERE action = 'card_access') AS actors, count(*) FILTER (WHERE action = 'card_login' AND outcome = 'failure') AS failed_logins, count(*) FILTER (WHERE action = 'card_login' AND outcome = 'failure') > 5 AS too_many, CAST(floor((1709251200 - max(t) FILTER (WHERE action = 'key_rotation')) / 86400) AS BIGINT) AS rotation_age, coalesce(floor((1709251200 - max(t) FILTER (WHERE action = 'key_rotation')) / 86400) > 90, true) AS rotation_due FROM a""")
def pci_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.findings("pci", _actions(spark, sf_dir), _NOW)


@query(_ACTIONS + """, c AS (SELECT count(*) FILTER (WHERE action = 'sod_violation') AS mixed_duties, count(*) FILTER (WHERE action = 'admin_login' AND outcome = 'failure') AS failed_admin_logins FROM a) SELECT *, mixed_duties > 0 OR failed_admin_logins > 0 AS finding FROM c""")
def sox_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.findings("sox", _actions(spark, sf_dir), _NOW)


@query(_ACTIONS + """, c AS (SELECT count(*) FILTER (WHERE action = 'phi_access' AND outcome = 'denied') AS denied_access, count(*) FILTER (WHERE action = 'breach_event') AS breaches, count(*) FILTER (WHERE action LIKE '%login' AND outcome = 'failure') AS failed_logins FROM a) SELECT *, denied_access > 0 OR breaches > 0 OR failed_logins > 5 AS finding FROM c""")
def hipaa_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.findings("hipaa", _actions(spark, sf_dir), _NOW)


@query(_ACTIONS + """ SELECT count(*) FILTER (WHERE action = 'dsr_request') AS requests, count(*) FILTER (WHERE action = 'dsr_request' AND outcome <> 'success' AND 1709251200 - t > 2592000) AS overdue, count(*) FILTER (WHERE action = 'breach_notification') AS notified, greatest(count(*) FILTER (WHERE action = 'breach_event') - count(*) FILTER (WHERE action = 'breach_notification'), 0) AS not_notified FROM a""")
def gdpr_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.findings("gdpr", _actions(spark, sf_dir), _NOW)
