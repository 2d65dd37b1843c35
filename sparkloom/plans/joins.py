"""Keyed lookups, temporal joins, graphs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import joins, sessions, sketches, stats
from sparkloom.operators import series as timeline
from sparkloom.plans.registry import events, query, read, seconds


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return joins.latest_per_key(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_orderstatus AS status, count(*) AS customers FROM r WHERE rn = 1 GROUP BY 1""")
def latest_then_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    latest = joins.latest_per_key(rows, "o_custkey", "o_orderdate", "o_orderkey")
    return latest.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("customers"))


@query("""WITH k AS (SELECT DISTINCT c_custkey AS o_custkey FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT k.o_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn), '') AS orders FROM k LEFT JOIN r ON r.o_custkey = k.o_custkey AND rn <= 3 GROUP BY 1""")
def rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list for each requested key, at most three values, empty for a key without rows."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    lists = joins.grouped_by_key(keys, read(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey").cast("string"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return lists.select("o_custkey", F.array_join("values", ",").alias("orders"))


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice > 480000""")
def enriched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their dimensions: which sides are broadcast is decided by their measured sizes."""
    t = lambda name: read(spark, sf_dir, name)
    orders = t("orders").where("o_totalprice > 480000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated before the join: a row a customer is shuffled, not an order."""
    totals = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return read(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_quantity = 50")
    return read(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("""SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)""")
def bloom_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bloom filter first, the exact keys for what passes it."""
    rows = events(spark, sf_dir)
    keys = rows.where("event_type = 'purchase' AND value > 95").select("user_id").distinct()
    bits, hashes = sketches.bloom_bits(100_000, 0.01)
    maybe = sketches.maybe_members(rows, "user_id", sketches.bloom_filter(keys, "user_id", bits, hashes), bits, hashes)
    return maybe.join(keys, "user_id", "left_semi").select("event_id")


_NEAREST = """WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), r AS (SELECT event_id AS rid, user_id AS ruser, epoch_us(ts) AS rt FROM events WHERE event_type = 'purchase'),
    p AS (SELECT event_id, rid, abs(rt - t) AS d, rt < t AS earlier FROM l JOIN r ON user_id = ruser AND abs(rt - t) <= 3600000000), m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, earlier, rid) AS rn FROM p)
    SELECT event_id, rid AS event_id_near, round(d / 1e6, 3) AS distance FROM m WHERE rn = 1"""


@query(_NEAREST)
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the same user's purchase nearest in time, within an hour."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", seconds("ts").alias("t"))
    near = joins.nearest(rows.where("event_type = 'error'"), rows.where("event_type = 'purchase'"), "t", "event_id", "event_id", "user_id", 3600.0)
    return near.withColumn("distance", F.round("distance", 3))


@query("""SELECT e.event_id, p.value AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value")
    left = rows.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return joins.as_of(left, rows.where("event_type = 'purchase'"), "user_id", "ts", "value").select("event_id", "value_as_of")


@query("""WITH x AS (SELECT event_id, event_type, user_id % 10 AS s, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type IN ('error', 'signup')) SELECT a.event_id AS cause, b.event_id AS effect, round(0.5 + CASE WHEN a.event_type = 'error' THEN 0.2 ELSE 0 END - (b.t - a.t) / 3600.0 * 0.3, 6) AS weight FROM x a JOIN x b ON b.t - a.t >= 0 AND b.t - a.t <= 600 AND a.event_id <> b.event_id AND (a.s = b.s OR (a.s + 1) % 10 = b.s)""")
def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u before v within ten minutes, of the same service or one that depends on it. The interval join is an equi-join on
    time buckets."""
    x = events(spark, sf_dir).where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type", (F.col("user_id") % 10).alias("s"), seconds("ts").alias("t"))
    pairs = joins.within(x, x, 600.0, "t").where("l.event_id <> r.event_id AND (l.s = r.s OR (l.s + 1) % 10 = r.s)")
    weight = 0.5 + F.when(F.col("l.event_type") == "error", 0.2).otherwise(0.0) - (F.col("r.t") - F.col("l.t")) / 3600.0 * 0.3
    return pairs.select(F.col("l.event_id").alias("cause"), F.col("r.event_id").alias("effect"), F.round(weight, 6).alias("weight"))


@query("""SELECT event_id, coalesce(lag(event_id) OVER w, -1) AS previous, coalesce(lead(event_id) OVER w, -1) AS next, row_number() OVER w AS place, round((epoch_us(ts) - first(epoch_us(ts)) OVER w) / 1e6, 3) AS offset_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def timeline_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).select("event_id", F.lag("event_id", 1, -1).over(w).alias("previous"), F.lead("event_id", 1, -1).over(w).alias("next"), F.row_number().over(w).cast("long").alias("place"), F.round((t - F.first(t).over(w)) / 1e6, 3).alias("offset_s"))


@query("""WITH u AS (SELECT 'event' AS kind, user_id AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events UNION ALL SELECT 'order', o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) FROM orders) SELECT k, kind, moment, id FROM u WHERE rn <= 3""")
def correlated_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three rows of each stream for each key, as one list."""

    def newest(df: DataFrame, kind: str, key: str, ts: str, id_: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(id_)))
        return df.withColumn("rn", rank).where("rn <= 3").select(F.col(key).alias("k"), F.lit(kind).alias("kind"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col(id_).alias("id"))

    return newest(events(spark, sf_dir), "event", "user_id", "ts", "event_id").unionByName(newest(read(spark, sf_dir, "orders"), "order", "o_custkey", "o_orderdate", "o_orderkey"))


@query("""SELECT user_id, count(DISTINCT event_type) AS sources, round(count(DISTINCT event_type) / 5.0, 6) AS strength, round(0.7 + 0.3 * count(DISTINCT event_type) / 5.0, 6) AS confidence FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2""")
def session_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("sources")
    grouped = events(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("event_type").alias("sources")).where("sources >= 2")
    return grouped.select("user_id", "sources", F.round(n / 5.0, 6).alias("strength"), F.round(0.7 + 0.3 * n / 5.0, 6).alias("confidence"))


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query(_SESSIONS + """ SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS duration, count(DISTINCT event_type) AS kinds, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS stage FROM s GROUP BY 1, 2""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("*", seconds("ts").alias("t"))
    stage = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return timeline.sessions(rows, "user_id", "t", 1800.0, "event_id").groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("duration"), F.countDistinct("event_type").alias("kinds"), F.max(stage).alias("stage"))


@query(_SESSIONS + """, f AS (SELECT user_id, session, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS stage FROM s GROUP BY 1, 2) SELECT CAST(i AS BIGINT) AS stage, count(*) FILTER (WHERE f.stage >= i) AS sessions, round(100.0 * count(*) FILTER (WHERE f.stage >= i) / count(*), 4) AS percent FROM f, range(4) r(i) GROUP BY 1""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that reach each stage; a session counts for all stages below its highest."""
    reached = gap_sessions(spark, sf_dir).select("stage")
    total = reached.agg(F.count(F.lit(1)).alias("total"))
    each = reached.select(F.explode(F.sequence(F.lit(0), F.col("stage"))).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("sessions"))
    found = spark.range(4).select(F.col("id").alias("stage")).join(each, "stage", "left").na.fill(0)
    return found.crossJoin(F.broadcast(total)).select("stage", "sessions", F.round(100.0 * F.col("sessions") / F.col("total"), 4).alias("percent"))


@query()
def hybrid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap, a longest duration, closing events and re-opening of similar ones: sequential for each user."""
    rows = events(spark, sf_dir).select("user_id", "event_id", seconds("ts").alias("t"), "event_type")
    return sessions.hybrid(rows, timeout=1800.0, longest=14_400.0, closing=("purchase",), merge_within=300.0, similar=0.7)


@query("""WITH e AS (SELECT event_id, user_id % 10 AS s, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), g AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) <= 300000000 THEN 0 ELSE 1 END AS new FROM e), c AS (SELECT *, sum(new) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cascade FROM g)
    SELECT CAST(cascade AS BIGINT) AS cascade, count(*) AS n, count(DISTINCT s) AS sources, arg_min(s, t) AS root FROM c GROUP BY 1 HAVING count(DISTINCT s) >= 2""")
def error_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of errors with gaps of at most five minutes over all services. The gaps are found day by day, with the last error
    of the days before, so no window holds all rows; a running count of cascades a day numbers them."""
    e = events(spark, sf_dir).where("event_type = 'error'").select("event_id", (F.col("user_id") % 10).alias("s"), seconds("ts").alias("t"))
    e = e.withColumn("day", F.floor(F.col("t") / 86400))
    ends = e.groupBy("day").agg(F.max("t").alias("last"))
    before = ends.select("day", F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("day")).alias("before"))  # a row a day
    w = Window.partitionBy("day").orderBy("t", "event_id")
    gap = F.col("t") - F.coalesce(F.lag("t").over(w), F.col("before"))
    marked = e.join(F.broadcast(before), "day").withColumn("new", F.when(gap <= 300, 0).otherwise(1))
    days = marked.groupBy("day").agg(F.sum("new").alias("k"))
    offset = days.select("day", (F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("day")) - F.col("k")).alias("offset"))
    numbered = marked.join(F.broadcast(offset), "day").withColumn("cascade", F.col("offset") + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("cascade").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("sources"), F.min_by("s", "t").alias("root")).where("sources >= 2")


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation i calls nation (i * 7 + 1) mod 25 and those of its region with a larger key."""
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 1) % 25).cast("long").alias("dst")).where("src <> dst").distinct()


@query("""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 7 + 1) % 25 AS BIGINT) AS dst FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 1) % 25), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, count(*) AS reach FROM r GROUP BY 1""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reachable(_dependencies(spark, sf_dir)).groupBy("src").agg(F.count(F.lit(1)).alias("reach"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 25 AS node, count(*) AS w FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT node, w / CAST(sum(w) OVER () AS DOUBLE) AS base FROM e),
    r(node, s, k) AS (SELECT node, 0.15 * base, 0 FROM b UNION ALL SELECT n.n_nationkey, r.s * 0.85, k + 1 FROM r JOIN nation n ON (n.n_nationkey * 7 + 1) % 25 = r.node AND n.n_nationkey <> r.node WHERE k < 170),
    t AS (SELECT node, sum(s) AS s FROM r GROUP BY 1) SELECT CAST(n_nationkey AS BIGINT) AS node, round(coalesce(s, 0) / (SELECT sum(s) FROM t), 6) AS score FROM nation LEFT JOIN t ON t.node = n_nationkey""")
def root_cause_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random walk with restarts at the errors, against the direction of the calls."""
    errors = events(spark, sf_dir).where("event_type = 'error'").groupBy((F.col("user_id") % 25).alias("node")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    edges = _dependencies(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return stats.random_walk(edges, errors, tolerance=1e-9, most_rounds=180, rounds_between=15).select("node", F.round("score", 6).alias("score"))


@query("""SELECT user_id, event_type, count(*) AS n FROM events JOIN (SELECT user_id AS u, max(value) AS top FROM events GROUP BY 1) ON user_id = u AND value > top * 0.9 GROUP BY 1, 2""")
def user_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    top = rows.groupBy("user_id").agg(F.max("value").alias("top"))
    return rows.join(top, "user_id").where(F.col("value") > F.col("top") * 0.9).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM l WHERE rn = 1 AND value >= 5""")
def compacted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row for each key wins; keys whose last row is a tombstone (here: a value below 5) go."""
    best = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("b"))
    return best.where("b.value >= 5").select("user_id", "event_type", "b.event_id", "b.value")


@query("""SELECT o_custkey, day, spent, spent <= 300000 AS within FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS day, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey), 2) AS spent FROM orders)""")
def cumulative_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM")
    w = Window.partitionBy("o_custkey", day).orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.round(F.sum("o_totalprice").over(w), 2)
    return read(spark, sf_dir, "orders").select("o_custkey", day.alias("day"), spent.alias("spent"), (spent <= 300000).alias("within"))
