"""Streaming queries, run over the stored tables to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query, read
from sparkloom.streaming import engine, stateful, windows

_AGG = "count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most"


def _events(spark: SparkSession, sf_dir: str, late: str = "60 days") -> DataFrame:
    read(spark, sf_dir, "events")  # sets the zone
    return windows.timed(engine.read_stream(spark, sf_dir, "events"), late=late)


@query(f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, {_AGG} FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.complete(windows.tumbling(_events(spark, sf_dir), "1 hour", ["event_type"]))


@query(f"""SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(b - o * 1800 AS BIGINT)), '%Y-%m-%d %H:%M') AS window_start, {_AGG} FROM (SELECT *, CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS b FROM events), range(2) r(o) GROUP BY 1""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.complete(windows.tumbling(_events(spark, sf_dir), "1 hour", slide="30 minutes"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.complete(windows.sessions(_events(spark, sf_dir), "user_id", "30 minutes"))


@query("""SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2""")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = windows.deduplicated(_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type")
    return engine.appended(first).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type, value, CASE WHEN value >= 50 THEN 'slow' ELSE 'ok' END AS class FROM events WHERE event_type IN ('error', 'purchase')""")
def stream_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where(F.col("event_type").isin("error", "purchase"))
    return engine.appended(rows.select("event_id", "event_type", "value", F.when(F.col("value") >= 50, "slow").otherwise("ok").alias("class")))


@query("""SELECT e.event_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'purchase'""")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("event_type = 'purchase'")
    return engine.appended(rows.join(read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@query("""SELECT route, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 60 THEN 'large' WHEN event_type = 'view' THEN 'views' ELSE 'dead_letter' END AS route FROM events) GROUP BY 1""")
def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch is split over sinks; a batch that is run again replaces its own part."""
    import uuid

    place = f"{engine.shared_dir(spark)}/routes-{uuid.uuid4().hex}"
    routes = {"errors": F.col("event_type") == "error", "large": F.col("value") > 60, "views": F.col("event_type") == "view"}

    def put(batch: DataFrame, n: int) -> None:
        windows.routed(batch, routes, lambda name, df: df.write.mode("overwrite").parquet(f"{place}/route={name}/batch={n}"))

    engine.run(_events(spark, sf_dir), "append", put)
    return spark.read.parquet(place).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) AS n, round(arg_max(value, ts), 6) AS last_value FROM events GROUP BY 1""")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "value")).alias("m"))
    return engine.complete(out.select("user_id", "n", F.round("m.value", 6).alias("last_value")))


@query()
def stream_hybrid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential session rules on a stream, with the state of each user in the state store."""
    return stateful.hybrid_sessions(_events(spark, sf_dir), timeout=1800.0, longest=14_400.0, closing=("purchase",), merge_within=300.0, similar=0.7)
