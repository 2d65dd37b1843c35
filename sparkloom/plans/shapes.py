"""Pivots, grouping sets, bands, text positions, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import models, search
from sparkloom.plans.registry import events, query, read, seconds


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1""")
def pivoted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT s_suppkey, name, v FROM supplier UNPIVOT (v FOR name IN (s_acctbal, twice)) """.replace("FROM supplier", "FROM (SELECT s_suppkey, s_acctbal, round(s_acctbal * 2, 2) AS twice FROM supplier)"))
def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.round(F.col("s_acctbal") * 2, 2).alias("twice")).unpivot("s_suppkey", ["s_acctbal", "twice"], "name", "v")


@query("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return spark.sql("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM _orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("""SELECT CASE WHEN value < 10 THEN 'fast' WHEN value < 40 THEN 'medium' ELSE 'slow' END AS band, least(CAST(floor(value / 10) AS BIGINT), 9) AS bucket, count(*) AS n FROM events GROUP BY 1, 2""")
def latency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).groupBy(F.when(v < 10, "fast").when(v < 40, "medium").otherwise("slow").alias("band"), F.least(F.floor(v / 10), F.lit(9)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, token, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS places FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), lambda w: w NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'he', 'in', 'is', 'it', 'its', 'of', 'on', 'that', 'the', 'to', 'was', 'were', 'will', 'with')) AS w FROM documents)) GROUP BY 1, 2""")
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.positions(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "token", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("places"))


@query("""SELECT p_partkey, levenshtein(p_name, 'red bolt') AS distance FROM part WHERE levenshtein(p_name, 'red bolt') <= 4""")
def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.levenshtein("p_name", F.lit("red bolt"))
    return read(spark, sf_dir, "part").select("p_partkey", d.cast("long").alias("distance")).where("distance <= 4")


@query("""WITH q AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, sum(l_extendedprice) AS p, sum(l_extendedprice * (1 - l_discount)) AS d, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS c, avg(l_discount) AS a, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, round(q, 2) AS sum_qty, round(p, 2) AS sum_base, round(d, 2) AS sum_disc, round(c, 2) AS sum_charge, round(a, 6) AS avg_disc, n FROM q""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, off = F.col("l_extendedprice"), 1 - F.col("l_discount")
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * off), 2).alias("sum_disc"), F.round(F.sum(price * off * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY) GROUP BY 1""")
def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), late, "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM r WHERE rank <= 3""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@query()
def behaviour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the mean and number of their events."""
    users = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    return models.kmeans(users, "user_id", ["mean", "n"], 4)


@query()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).where("event_type = 'error'").select("event_id", (seconds("ts") / 3600).alias("x"), F.col("value").alias("y"))
    return models.dbscan(points, "event_id", "x", "y", 3.0, 4)


@query()
def outlier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    return models.isolation_scores(rows, "event_id", ["value", "hour"])


@query()
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels learned from term frequencies, predicted for all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.join(read(spark, sf_dir, "labels"), "doc_id").select("text", "quality")
    return models.text_classifier(train, docs, "text", "quality", "doc_id").select("doc_id", "prediction", F.round("probability", 6).alias("probability"))
