"""De-duplication, conflict resolution, alerts, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import resolve, stats
from sparkloom.plans.joins import _dependencies
from sparkloom.plans.registry import events, query, read, seconds


@query("""SELECT event_id FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap > 7200000000""")
def time_window_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", seconds("ts").alias("t"))
    return resolve.not_repeated(rows, ["user_id", "event_type"], "t", 7200.0, "event_id").select("event_id")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_type, i, t AS kept, 1 AS passed FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_type, o.i, CASE WHEN o.t - r.kept >= 21600000000 THEN o.t ELSE r.kept END, CASE WHEN o.t - r.kept >= 21600000000 THEN r.passed + 1 ELSE r.passed END FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.i = r.i + 1)
    SELECT user_id, event_type, CAST(max(passed) AS BIGINT) AS passed, max(i) AS n FROM r GROUP BY 1, 2""")
def ttl_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache with a lifetime of six hours lets pass, for each user and type."""
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    marked = resolve.passes_ttl(rows, ["user_id", "event_type"], "t", ["ts", "event_id"], 21_600_000_000)
    return marked.groupBy("user_id", "event_type").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 10 <> 4) SELECT coalesce(a.k, b.k) AS k, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def replica_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    other = orders.where("k % 10 <> 4").withColumn("v", F.when(F.col("k") % 50 == 7, F.col("v") + 1).otherwise(F.col("v")))
    return resolve.replica_diff(orders.where("k % 10 <> 3"), other, "k", "v")


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas, each with its last version of a key and a clock that counts its own writes: clocks are concurrent, so the
    fold over vector clocks ends with the version that was written last."""
    replica = (F.col("event_id") % 3).cast("string")
    last = events(spark, sf_dir).groupBy("user_id", "event_type", replica.alias("replica")).agg(F.max(F.struct("event_id", "value")).alias("v"), F.count(F.lit(1)).alias("writes"))
    versions = last.select(F.struct("user_id", "event_type").alias("key"), F.create_map("replica", "writes").alias("clock"), "v.event_id", "v.value")
    return resolve.resolved(versions, "key", "clock", "event_id").select("key.user_id", "key.event_type", "event_id", "value")


@query("""WITH e AS (SELECT user_id % 10 AS s, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'error'), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY s ORDER BY t, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM e), c AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS alert FROM g)
    SELECT s, CAST(alert AS BIGINT) AS alert, count(*) AS n, CASE WHEN count(*) >= 6 THEN 'critical' WHEN count(*) >= 3 THEN 'open' ELSE 'new' END AS state FROM c GROUP BY 1, 2""")
def alert_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a service within an hour of the last one belong to its open alert, which escalates at twice the threshold."""
    from sparkloom.operators import series

    e = events(spark, sf_dir).where("event_type = 'error'").select((F.col("user_id") % 10).alias("s"), seconds("ts").alias("t"), "event_id")
    grouped = series.sessions(e, "s", "t", 3600.0, "event_id").groupBy("s", F.col("session").alias("alert")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("state", F.when(F.col("n") >= 6, "critical").when(F.col("n") >= 3, "open").otherwise("new"))


@query("""SELECT c_custkey, c_name, length(c_name) AS n FROM customer""")
def encrypted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields encrypted with AES-GCM, bound to their record's id, and decrypted again."""
    key, iv = F.lit(b"0123456789abcdef"), F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 12).cast("binary")
    aad = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    sealed = read(spark, sf_dir, "customer").select("c_custkey", F.aes_encrypt(F.col("c_name").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad.cast("binary")).alias("secret"))
    opened = F.aes_decrypt("secret", key, F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")).cast("string")
    return sealed.select("c_custkey", opened.alias("c_name"), F.length(opened).cast("long").alias("n"))


@query("""SELECT event_type AS action, user_id % 3 AS actor, count(*) AS total, count(*) FILTER (WHERE value < 30) AS allowed, count(*) FILTER (WHERE value >= 30) AS denied FROM events GROUP BY 1, 2""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("action"), (F.col("user_id") % 3).alias("actor")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") < 30).alias("allowed"), F.count_if(F.col("value") >= 30).alias("denied"))


@query("""SELECT count(*) AS requests, count(DISTINCT o_custkey) AS users, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, round(count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(*), 1), 6) AS ratio FROM orders""")
def erasure_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, n = F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))
    return read(spark, sf_dir, "orders").agg(n.alias("requests"), F.countDistinct("o_custkey").alias("users"), done.alias("completed"), F.round(done / F.greatest(n, F.lit(1)), 6).alias("ratio"))


@query("""SELECT user_id AS k, count(*) AS n, round(count(*) * pow(0.5, (epoch(TIMESTAMP '2024-02-01') - max(epoch_us(ts)) / 1e6) / 86400) * (1 + avg(value) / 100), 6) AS score FROM events GROUP BY 1 ORDER BY score DESC, k LIMIT 20""")
def hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency, recency and cost in one score."""
    age = (F.lit(1706745600.0) - F.max(seconds("ts"))) / 86400
    scored = events(spark, sf_dir).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * F.pow(F.lit(0.5), age) * (1 + F.avg("value") / 100), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "k").limit(20)


@query("""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 7 + 1) % 25 AS BIGINT) AS dst FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 1) % 25), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), c AS (SELECT src, count(*) AS n FROM r GROUP BY 1) SELECT r.dst AS service, c.n AS downstream FROM r JOIN c ON c.src = r.dst WHERE r.src = 3 ORDER BY downstream DESC, service LIMIT 5""")
def recovery_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services downstream of a root, by how much is downstream of them; leaves are left out."""
    reach = stats.reachable(_dependencies(spark, sf_dir))
    counts = reach.groupBy(F.col("src").alias("service")).agg(F.count(F.lit(1)).alias("downstream"))
    return reach.where("src = 3").select(F.col("dst").alias("service")).join(counts, "service").orderBy(F.desc("downstream"), "service").limit(5)


@query("""WITH o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 - (user_id % 5) * 2 AS t FROM events) SELECT event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY t, event_id) AS place FROM o""")
def clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order after each service's known offset is taken off its times."""
    rows = events(spark, sf_dir).select("event_id", "user_id", (seconds("ts") - (F.col("user_id") % 5) * 2).alias("t"))
    w = Window.partitionBy(F.col("user_id") % 20).orderBy("t", "event_id")
    return rows.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT event_id, list_filter([CASE WHEN NOT value < 90 THEN 'value' END, CASE WHEN NOT contains(props, '"k"') THEN 'props' END, CASE WHEN NOT user_id % 7 <> 0 THEN 'user' END], lambda x: x IS NOT NULL) AS broken FROM events""")
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.operators import schemas

    rules = {"value": F.col("value") < 90, "props": F.contains("props", F.lit('"k"')), "user": F.col("user_id") % 7 != 0}
    return events(spark, sf_dir).select("event_id", schemas.violations(rules).alias("broken"))


@query("""SELECT user_id, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 8""")
def actor_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n")).where("n > 8")


@query("""WITH d AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, avg(value) AS m FROM events GROUP BY 1, 2), f AS (SELECT user_id, m, avg(m) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, row_number() OVER (PARTITION BY user_id ORDER BY day) AS fold FROM d) SELECT fold, count(*) AS n, round(avg(abs(m - p)), 6) AS mae FROM f WHERE fold > 5 GROUP BY 1""")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's mean forecast by the mean of all days before it."""
    daily = events(spark, sf_dir).groupBy("user_id", F.floor(seconds("ts") / 86400).alias("day")).agg(F.avg("value").alias("m"))
    w = Window.partitionBy("user_id").orderBy("day")
    rows = daily.select("m", F.avg("m").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), F.row_number().over(w).cast("long").alias("fold")).where("fold > 5")
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("m") - F.col("p"))), 6).alias("mae"))


@query("""WITH s AS (SELECT user_id, round(avg(value), 4) / 40 AS load FROM events GROUP BY 1) SELECT user_id, CASE WHEN load > 0.85 THEN 'high' WHEN load >= 0.65 THEN 'medium' ELSE 'low' END AS level FROM s""")
def alert_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = F.round(F.avg("value"), 4) / 40
    return events(spark, sf_dir).groupBy("user_id").agg(load.alias("load")).select("user_id", F.when(F.col("load") > 0.85, "high").when(F.col("load") >= 0.65, "medium").otherwise("low").alias("level"))
