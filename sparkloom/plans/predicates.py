"""Projection, filters, sorting, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import logic, scoring
from sparkloom.operators import filters
from sparkloom.plans.registry import events, query, read


@query("""SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS missing FROM events WHERE user_id = 5""")
def project_and_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("user_id = 5").select("event_id", F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("missing"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_id FROM e WHERE NOT coalesce(v = 10.5, false) AND NOT coalesce(v < 90, false)""")
def two_valued_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison with null is false, so its negation is true."""
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    return rows.where(~logic.loose("=", F.col("v"), 10.5) & ~logic.loose("<", F.col("v"), 90)).select("event_id")


@query("""SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 95""")
def loose_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text compared with a number is read as a number."""
    rows = events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return rows.where(logic.loose(">=", F.col("k"), 95)).select("event_id")


@query("""SELECT event_id, user_id FROM events WHERE user_id IN (1, 2, 3) AND value BETWEEN 10 AND 20 AND event_type <> 'view'""")
def in_and_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = logic.is_in(F.col("user_id"), [1, 2, 3]) & logic.between(F.col("value"), 10, 20) & logic.compare("!=", F.col("event_type"), F.lit("view"))
    return events(spark, sf_dir).where(keep).select("event_id", "user_id")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red w')""")
def contains_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(logic.contains(F.col("p_name"), "RED W")).select("p_partkey", "p_name")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS t FROM events) SELECT event_id FROM e WHERE t IS NULL OR t <> 'view'""")
def storage_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storage rule: ne takes null rows too."""
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("t"))
    return rows.where(filters.leaf("t", "ne", "view")).select("event_id")


_LEVELS = {"o_orderpriority": {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}}


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT (o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')) AND CAST(left(o_orderpriority, 1) AS INT) <= 2""")
def search_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of all, any and not; priorities are ordered by their ordinals."""
    tree = {"all": [
        {"any": [{"field": "o_orderstatus", "op": "eq", "value": "F"}, {"field": "o_totalprice", "op": "gt", "value": 400000.0}]},
        {"not": {"field": "o_orderpriority", "op": "in", "value": ["5-LOW", "4-NOT SPECIFIED"]}},
        {"field": "o_orderpriority", "op": "lte", "value": "2-HIGH"},
        {"all": []},
    ]}
    return read(spark, sf_dir, "orders").where(filters.tree(tree, _LEVELS)).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE strftime(ts, '%H:%M') >= '22:30' OR strftime(ts, '%H:%M') <= '01:15'""")
def time_of_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(filters.time_of_day(F.col("ts"), "22:30", "01:15")).select("event_id")


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06 12:00:00'""")
def half_open_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-06 12:00:00'").select("event_id")


@query("""SELECT page_id, list_filter([CASE WHEN contains(url, '/en/') THEN 'english' END, CASE WHEN regexp_matches(url, '[?&]utm_') THEN 'campaign' END, 'scheme:' || split_part(url, ':', 1)], lambda t: t IS NOT NULL) AS tags FROM pages WHERE NOT regexp_matches(url, '#top$') AND regexp_matches(url, 'example[.](com|org)')""")
def include_exclude_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions win over inclusions; then each tag whose pattern hits."""
    url = F.col("url")
    tags = F.array_compact(F.array(F.when(url.contains("/en/"), "english"), F.when(url.rlike("[?&]utm_"), "campaign"), F.concat(F.lit("scheme:"), F.split_part(url, F.lit(":"), F.lit(1)))))
    return read(spark, sf_dir, "pages").where(~url.rlike("#top$") & url.rlike("example[.](com|org)")).select("page_id", tags.alias("tags"))


@query("""SELECT event_id, value, ts FROM (SELECT event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE event_type = 'purchase') ORDER BY value DESC, event_id LIMIT 15""")
def top_k_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return rows.orderBy(F.desc("value"), "event_id").limit(15).select("event_id", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""SELECT event_id, user_id FROM events WHERE user_id < 40 OR (user_id = 40 AND event_id < 5000) ORDER BY user_id DESC, event_id DESC LIMIT 26""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page after (40, 5000), with one row of look-ahead."""
    return filters.keyset_page(events(spark, sf_dir), ["user_id", "event_id"], [40, 5000], 25).select("event_id", "user_id")


@query("""SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS v FROM customer) ORDER BY v DESC NULLS FIRST, c_custkey LIMIT 30 OFFSET 10""")
def order_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("v"))
    return rows.orderBy(F.col("v").desc_nulls_first(), "c_custkey").offset(10).limit(30)


@query("""SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 450000""")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(orders.where("o_totalprice > 450000").select("o_custkey"))


@query("""SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 490000""")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("k"))
    return rich.union(read(spark, sf_dir, "orders").where("o_totalprice > 490000").select("o_custkey")).distinct()


@query("""WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase' AND value > 80), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error' AND value > 80) (SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b)) UNION ALL (SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a))""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one side lacks, by one full join."""
    of = lambda t: events(spark, sf_dir).where((F.col("event_type") == t) & (F.col("value") > 80)).select(F.col("user_id").alias("k")).distinct()
    both = of("purchase").withColumn("a", F.lit(1)).join(of("error").withColumn("b", F.lit(1)), "k", "full")
    return both.where("a is null or b is null").select("k", F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def first_seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS DOUBLE) AS tax FROM orders UNION ALL SELECT 'line', l_orderkey, l_extendedprice, l_tax FROM lineitem""")
def union_of_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two shapes; what one lacks is null."""
    orders = read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    lines = read(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_tax").alias("tax"))
    return orders.unionByName(lines, allowMissingColumns=True)


@query("""SELECT event_id, CASE WHEN value >= 40 THEN 'ERROR' WHEN value >= 20 THEN 'WARN' ELSE 'INFO' END AS level, CASE WHEN value >= 40 THEN 3 WHEN value >= 20 THEN 4 ELSE 6 END AS severity FROM events WHERE value >= 20""")
def severity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level from a measure, its syslog ordinal, and a filter by the ordinal."""
    v = F.col("value")
    level = F.when(v >= 40, "ERROR").when(v >= 20, "WARN").otherwise("INFO")
    return events(spark, sf_dir).select("event_id", level.alias("level"), scoring.severity(level).alias("severity")).where("severity <= 4")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'errors' WHEN contains(props, '9') THEN 'database' WHEN value > 50 THEN 'security' ELSE 'application' END AS topic FROM events""")
def topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("event_type") == "error", "errors").when(F.col("props").contains("9"), "database").when(F.col("value") > 50, "security").otherwise("application")
    return events(spark, sf_dir).select("event_id", topic.alias("topic"))


@query("""WITH rules(name, field, low, rank) AS (VALUES ('all', 'any', 0, 1), ('errors', 'error', 0, 2), ('large errors', 'error', 40, 3), ('large views', 'view', 40, 3)), m AS (SELECT event_id, name, row_number() OVER (PARTITION BY event_id ORDER BY rank DESC, name) AS r FROM events JOIN rules ON (field = 'any' OR field = event_type) AND value >= low) SELECT event_id, name FROM m WHERE r = 1""")
def best_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific rule that fits each row. The rules are a fixed few, so they are an expression, not a join."""
    rules = [("all", "any", 0, 1), ("errors", "error", 0, 2), ("large errors", "error", 40, 3), ("large views", "view", 40, 3)]
    name = None
    for rule, kind, low, _ in sorted(rules, key=lambda r: (-r[3], r[0])):
        fits = (F.col("value") >= low) & (F.lit(kind == "any") | (F.col("event_type") == kind))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
    return events(spark, sf_dir).select("event_id", name.alias("name")).where("name is not null")


@query("""SELECT user_id, event_type IN ('view', 'click') AND NOT user_id % 10 = 3 AS allowed, count(*) AS n FROM events GROUP BY 1, 2""")
def permission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denials before grants, else denied."""
    allowed = F.when(F.col("user_id") % 10 == 3, False).when(F.col("event_type").isin("view", "click"), True).otherwise(False)
    return events(spark, sf_dir).groupBy("user_id", allowed.alias("allowed")).agg(F.count(F.lit(1)).alias("n"))
