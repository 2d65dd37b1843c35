"""Aggregation: counts, shares, percentiles, facets, map and reduce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import dialect, filters, mapreduce, ordered
from sparkloom.operators import series as timeline
from sparkloom.plans.registry import events, query, read, seconds


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_share FROM events GROUP BY 1, 2""")
def requests_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_share"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) ELSE 0 END AS error_rate FROM events GROUP BY 1""")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.when(n > 0, F.round(F.count_if(F.col("event_type") == "error") / n, 6)).otherwise(0.0).alias("error_rate"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def average_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10""")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1""")
def group_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT count(*) AS n, coalesce(sum(value), 0.0) AS total, coalesce(avg(value), 0.0) AS mean, min(value) AS least FROM events WHERE event_type = 'nothing'""")
def aggregates_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without groups there is one row even for no input."""
    none = events(spark, sf_dir).where(F.col("event_type") == "nothing")
    return none.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.min("value").alias("least"))


@query("""SELECT event_type AS kind, COUNT(*) AS n, MAX(value) AS top FROM events WHERE value BETWEEN 5 AND 60 AND NOT event_type IN ('view') AND contains(lower(props), '"k"') GROUP BY event_type HAVING COUNT(*) > 10""")
def log_dialect_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT event_type AS kind, COUNT(*) AS n, MAX(value) AS top FROM events WHERE value BETWEEN 5 AND 60 AND event_type NOT IN ('view') AND props CONTAINS '"K"' GROUP BY event_type HAVING COUNT(*) > 10 ORDER BY n DESC"""
    return dialect.run(text, {"events": events(spark, sf_dir)})


@query("""SELECT event_id, user_id AS who, value FROM events WHERE (event_type = 'error' OR value >= 90) AND user_id <> 3 ORDER BY value DESC, event_id LIMIT 20 OFFSET 5""")
def log_dialect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run("SELECT event_id, user_id AS who, value FROM events WHERE (event_type = 'error' OR value >= 90) AND user_id != 3 ORDER BY value DESC, event_id LIMIT 20 OFFSET 5", {"events": events(spark, sf_dir)})


@query("""SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def log_dialect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", {"orders": read(spark, sf_dir, "orders")})


@query("""SELECT event_type FROM events GROUP BY event_type""")
def group_without_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run("SELECT event_type FROM events GROUP BY event_type", {"events": events(spark, sf_dir)})


_SELECTED = {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT"], "year": ["1996", "1800"]}


@query("""WITH o AS (SELECT o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y') AS year FROM orders),
    c AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM o WHERE o_orderpriority IN ('1-URGENT') AND year IN ('1996', '1800') GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM o WHERE o_orderstatus IN ('F', 'O') AND year IN ('1996', '1800') GROUP BY 2
    UNION ALL SELECT 'year', year, count(*) FROM o WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT') GROUP BY 2
    UNION ALL SELECT 'year', '1800', 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM c)
    SELECT dimension, value, n FROM r WHERE rank <= 5 OR (dimension = 'year' AND value IN ('1996', '1800')) OR (dimension = 'o_orderstatus' AND value IN ('F', 'O')) OR value = '1-URGENT'""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension counted under the filters of the others; selected values are there even at 0."""
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("year"))
    return filters.facets(orders, list(_SELECTED), _SELECTED, top=5)


@query("""SELECT l_returnflag, l_linestatus, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by counts of values and prefix sums: no task holds a group."""
    by, rows = ["l_returnflag", "l_linestatus"], read(spark, sf_dir, "lineitem")
    whole = rows.groupBy(*by).agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    found = ordered.linear_percentiles(rows, by, "l_extendedprice", {"p95": 95, "p99": 99}).select(*by, F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"))
    return whole.join(found, by, "left")


@query("""SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1""")
def percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = {"p95": lambda n: F.greatest(F.ceil(n * 95 / 100), F.lit(1)) - 1, "p50": lambda n: F.greatest(F.ceil(n * 50 / 100), F.lit(1)) - 1}
    return ordered.values_at_ranks(events(spark, sf_dir), ["event_type"], "value", ranks).select("event_type", "p95", "p50")


@query("""WITH l AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT user_id, v[least(CAST(floor(len(v) * 95 / 100) AS BIGINT) + 1, len(v))] AS p95_index, v[CAST(floor((len(v) - 1) * 95 / 100.0) AS BIGINT) + 1] AS p95_floor FROM l""")
def percentiles_index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = {"p95_index": lambda n: F.least(F.floor(n * 95 / 100), n - 1), "p95_floor": lambda n: F.floor((n - 1) * 95 / 100)}
    return ordered.values_at_ranks(events(spark, sf_dir), ["user_id"], "value", ranks).select("user_id", "p95_index", "p95_floor")


@query("""WITH n AS (SELECT user_id, avg(value) AS a FROM events GROUP BY 1) SELECT round(avg(a), 6) AS mean_of_means, round(sum(a), 4) AS sum_of_means, count(*) AS nodes FROM n""")
def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_node = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("a"))
    return per_node.agg(F.round(F.avg("a"), 6).alias("mean_of_means"), F.round(F.sum("a"), 4).alias("sum_of_means"), F.count(F.lit(1)).alias("nodes"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS slow, round(count(*) FILTER (WHERE value > 50) / count(*) * 100, 4) AS slow_percent, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def endpoint_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow, n = F.count_if(F.col("value") > 50), F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("event_type").agg(n.alias("n"), slow.alias("slow"), F.round(slow / n * 100, 4).alias("slow_percent"), F.countDistinct("user_id").alias("users"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def minute_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, CASE WHEN epoch(any_value(now)) - epoch(max(ts)) > 86400 THEN 'down' WHEN epoch(any_value(now)) - epoch(max(ts)) > 21600 THEN 'warning' ELSE 'healthy' END AS health FROM events, m GROUP BY 1""")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max(seconds("ts")).alias("seen"))
    now = last.agg(F.max("seen").alias("now"))
    age = F.col("now") - F.col("seen")
    return last.crossJoin(F.broadcast(now)).select("user_id", F.when(age > 86400, "down").when(age > 21600, "warning").otherwise("healthy").alias("health"))


@query("""SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders GROUP BY 1""")
def distinct_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.countDistinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"))


@query("""SELECT l_returnflag AS method, l_linestatus AS outcome, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2""")
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("outcome")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_orderkey").alias("orders"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def stats_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"))


@query("""SELECT coalesce(c_nationkey, -1) AS c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 4) AS balance FROM customer GROUP BY ROLLUP (customer.c_nationkey, c_mktsegment)""")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 4).alias("balance")).na.fill({"c_nationkey": -1})


@query("""SELECT 'event_type:' || event_type AS k, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'user:' || user_id, count(*) FROM events GROUP BY 1""")
def service_level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distributions in one pass: each row gives both keys."""
    keys = F.explode(F.array(F.concat(F.lit("event_type:"), "event_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string"))))
    return events(spark, sf_dir).select(keys.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT 'host' AS category, regexp_extract(url, '://([^/?#]*)', 1) AS value FROM pages UNION ALL SELECT 'lang', split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/', 1) FROM pages),
    c AS (SELECT category, value, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS rank FROM c) SELECT category, value, n FROM r WHERE rank <= 10""")
def top_ten_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    pair = F.explode(F.array(F.struct(F.lit("host").alias("category"), F.regexp_extract(url, "://([^/?#]*)", 1).alias("value")), F.struct(F.lit("lang").alias("category"), F.split_part(F.regexp_replace(url, "^[a-z]+://[^/]*/", ""), F.lit("/"), F.lit(1)).alias("value"))))
    counted = read(spark, sf_dir, "pages").select(pair.alias("p")).groupBy("p.category", "p.value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).where("rank <= 10").select("category", "value", "n")


@query("""SELECT hour(h.t) AS hour, count(e.event_id) AS n, round(CASE WHEN count(e.event_id) > 0 THEN count(*) FILTER (WHERE e.event_type = 'error') / count(e.event_id) ELSE 0 END, 6) AS error_rate FROM (SELECT TIMESTAMP '2024-01-01' + to_hours(i) AS t FROM range(24) r(i)) h LEFT JOIN events e ON hour(e.ts) = hour(h.t) GROUP BY 1""")
def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 hours, those without events as 0."""
    n = F.count("event_id")
    counted = events(spark, sf_dir).groupBy(F.hour("ts").cast("long").alias("hour")).agg(n.alias("n"), F.round(F.count_if(F.col("event_type") == "error") / n, 6).alias("error_rate"))
    return spark.range(24).withColumnRenamed("id", "hour").join(F.broadcast(counted), "hour", "left").na.fill(0)


@query("""WITH c AS (SELECT CAST(floor(epoch(ts) / 7200) AS BIGINT) AS b, count(*) AS n FROM events GROUP BY 1), m AS (SELECT min(b) AS lo, max(b) AS hi, greatest(CAST(ceil((max(b) - min(b) + 1) / 50.0) AS BIGINT), 1) AS k FROM c),
    a AS (SELECT unnest(range(0, CAST(floor((hi - lo) / k) AS BIGINT) + 1)) AS i, lo, k FROM m), f AS (SELECT CAST(floor((b - lo) / k) AS BIGINT) AS i, sum(n) AS n FROM c, m GROUP BY 1)
    SELECT (lo + a.i * k) * 7200 AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM a LEFT JOIN f USING (i)""")
def folded_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.histogram(events(spark, sf_dir), seconds("ts"), 7200, most=50)


@query("""SELECT props AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, message LIMIT 5""")
def top_error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == "error").groupBy(F.col("props").alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(5)


@query("""WITH c AS (SELECT hour(ts) AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e, list_sort(list(DISTINCT user_id) FILTER (WHERE event_type = 'error')) AS users FROM events GROUP BY 1), b AS (SELECT sum(e) / sum(n) AS base FROM c)
    SELECT hour, n, e AS errors, round(e / n / base, 6) AS ratio, len(users) AS users FROM c, b WHERE e / n / base >= 1.05 AND e >= 10""")
def hourly_error_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_error = F.col("event_type") == "error"
    counted = events(spark, sf_dir).groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error).alias("errors"), F.countDistinct(F.when(is_error, F.col("user_id"))).alias("users"))
    base = counted.agg((F.sum("errors") / F.sum("n")).alias("base"))
    ratio = F.col("errors") / F.col("n") / F.col("base")
    return counted.crossJoin(F.broadcast(base)).where((ratio >= 1.05) & (F.col("errors") >= 10)).select("hour", "n", "errors", F.round(ratio, 6).alias("ratio"), "users")


@query("""WITH c AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), s AS (SELECT *, n / sum(n) OVER (PARTITION BY weekday, hour) AS cell, sum(n) OVER (PARTITION BY event_type) / sum(n) OVER () AS overall FROM c),
    f AS (SELECT *, hour - row_number() OVER (PARTITION BY weekday, event_type ORDER BY hour) AS run FROM s WHERE cell / overall >= 1.2 AND n >= 5)
    SELECT weekday, event_type, min(hour) AS first_hour, max(hour) AS last_hour, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY weekday, event_type, run""")
def weekday_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of weekday and hour in which a type's share is large, neighbours merged into runs."""
    cells = events(spark, sf_dir).groupBy(F.weekday("ts").cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # at most 168 cells a type
    share = F.col("n") / F.sum("n").over(Window.partitionBy("weekday", "hour")) / (F.sum("n").over(Window.partitionBy("event_type")) / F.sum("n").over(every))
    bursts = cells.withColumn("ratio", share).where("ratio >= 1.2 AND n >= 5")
    run = F.col("hour") - F.row_number().over(Window.partitionBy("weekday", "event_type").orderBy("hour"))
    return bursts.withColumn("run", run).groupBy("weekday", "event_type", "run").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.sum("n").alias("n")).drop("run")


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS raw FROM documents), LATERAL (SELECT regexp_replace(raw, '[^a-z]', '', 'g') AS w) WHERE length(w) > 2 GROUP BY 1""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("raw")).select(F.regexp_replace("raw", "[^a-z]", "").alias("word"))
    return words.where(F.length("word") > 2).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS k, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1""")
def map_reduce_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered map function and an algebraic reduction, which Spark combines on the map side."""
    return mapreduce.run(events(spark, sf_dir), "count_by_type", "sum")


@query("""SELECT event_type AS k, to_json(list_sort(list(DISTINCT user_id))) AS v FROM events GROUP BY 1""")
def map_reduce_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = events(spark, sf_dir).select(F.col("event_type").alias("k"), "user_id")
    return pairs.groupBy("k").agg(F.to_json(F.array_sort(F.collect_set("user_id"))).alias("v"))


@query("""SELECT o_orderpriority AS framework, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM orders GROUP BY 1 ORDER BY n DESC, framework""")
def share_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("framework")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2)).orderBy(F.desc("n"), "framework")


@query("""SELECT count(DISTINCT user_id) AS actors, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'error') > 100 AS over_threshold, CAST(floor((epoch(TIMESTAMP '2024-03-01') - epoch(max(ts))) / 86400) AS BIGINT) AS days_since FROM events""")
def compliance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = F.count_if(F.col("event_type") == "error")
    age = F.floor((F.lit(1709251200) - F.max(seconds("ts"))) / 86400)
    return events(spark, sf_dir).agg(F.countDistinct("user_id").alias("actors"), failures.alias("failures"), (failures > 100).alias("over_threshold"), age.alias("days_since"))


@query("""SELECT t.tier, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, count(d.doc_id) AS n FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')) t(tier) LEFT JOIN documents d ON d.lang = t.tier GROUP BY 1""")
def tier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known tier, those without rows at 0."""
    tiers = spark.createDataFrame([(t,) for t in ("en", "de", "fr", "es", "xx")], "tier string")
    totals = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("tier")).agg(F.sum("n_chars").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return tiers.join(totals, "tier", "left").na.fill(0)


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () > 1.2 / count(*) OVER () AS skewed FROM c""")
def load_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("users"))  # one row
    share = F.col("n") / F.col("total")
    return counted.crossJoin(F.broadcast(total)).select("user_id", "n", F.round(share, 6).alias("share"), (share > 1.2 / F.col("users")).alias("skewed"))


@query("""WITH a AS (SELECT date_trunc('day', ts) AS d, event_type, avg(value) AS a FROM events GROUP BY 1, 2) SELECT strftime(d, '%Y-%m-%d') AS day, CAST(greatest(0, 100 - sum(CASE WHEN a > 33 THEN 25 WHEN a > 28 THEN 10 ELSE 0 END)) AS BIGINT) AS health FROM a GROUP BY 1""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.avg("value").alias("a"))
    cost = F.sum(F.when(F.col("a") > 33, 25).when(F.col("a") > 28, 10).otherwise(0))
    return daily.groupBy("day").agg(F.greatest(F.lit(0).cast("long"), 100 - cost).alias("health"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n FROM c WHERE n > 1500""")
def high_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1500")


@query("""SELECT event_id, m.metric, m.v FROM (SELECT event_id, unnest([{'metric': 'value', 'v': value}, {'metric': 'k', 'v': CAST(json_extract_string(props, '$.k') AS DOUBLE)}]) AS m FROM events) t""")
def log_to_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each measured field of a log row."""
    rows = events(spark, sf_dir)
    fields = F.explode(F.array(F.struct(F.lit("value").alias("metric"), F.col("value").alias("v")), F.struct(F.lit("k").alias("metric"), F.get_json_object("props", "$.k").cast("double").alias("v"))))
    return rows.select("event_id", fields.alias("m")).select("event_id", "m.metric", "m.v")


@query("""SELECT event_type, count(*) AS exact FROM events GROUP BY 1""")
def approximate_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read back from a count-min sketch; at this width the estimates are exact."""
    from sparkloom.operators.sketches import frequencies

    return frequencies(events(spark, sf_dir), "event_type").withColumnRenamed("estimate", "exact")


@query("""SELECT event_type AS failure, count(*) AS n, round(avg(value), 6) AS mean_retries, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1""")
def dead_letter_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return events(spark, sf_dir).where(F.col("event_type").isin("error", "signup")).groupBy(F.col("event_type").alias("failure")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_retries"), time(F.min("ts")).alias("oldest"), time(F.max("ts")).alias("newest"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING bool_or(event_type = 'purchase') AND count(DISTINCT event_type) = 5""")
def having_on_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.countDistinct("event_type").alias("types"))
    return grouped.where("bought AND types = 5").select("user_id", "n")
