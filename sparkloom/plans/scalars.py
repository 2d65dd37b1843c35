"""Scalar functions: times, hashes, masks, arrays, maps, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.operators.layout import ring_node, ring_points
from sparkloom.plans.registry import events, query, read, seconds


@query("""SELECT event_id, round(pow(0.5, (epoch(TIMESTAMP '2024-02-01') - epoch_us(ts) / 1e6) / 86400 / 7), 8) AS weight FROM events""")
def recency_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.lit(1706745600.0) - seconds("ts")) / 86400
    return events(spark, sf_dir).select("event_id", F.round(scoring.half_life(age, 7.0), 8).alias("weight"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'bounce' WHEN o_totalprice < 250000 THEN 'low' WHEN o_totalprice < 400000 THEN 'moderate' ELSE 'high' END AS class, CAST(floor(epoch(o_orderdate) / 86400 / 7) AS BIGINT) AS week FROM orders""")
def engagement_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(p < 100000, "bounce").when(p < 250000, "low").when(p < 400000, "moderate").otherwise("high").alias("class"), F.floor(seconds("o_orderdate") / 86400 / 7).alias("week"))


@query("""SELECT c_custkey, substr(sha256('salt' || c_name), 1, 32) AS hashed, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS masked, md5(c_name) AS digest FROM customer""")
def hashes_and_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", text.salted_id(name, "salt").alias("hashed"), text.partly_masked(name).alias("masked"), F.md5(name.cast("binary")).alias("digest"))


@query("""SELECT c_custkey, CAST(md5_number(c_name) % 10 AS INTEGER) AS node FROM customer""")
def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """md5 modulo the number of nodes, the whole 128 bits."""
    # md5_number reads the digest's bytes from the other end
    digest = F.md5(F.col("c_name").cast("binary"))
    swapped = F.array_join(F.reverse(F.regexp_extract_all(digest, F.lit("[0-9a-f]{2}"), F.lit(0))), "")
    half = lambda at: F.conv(F.substring(swapped, at, 16), 16, 10).cast("decimal(20,0)") % 10
    return read(spark, sf_dir, "customer").select("c_custkey", ((half(1) * (2**64 % 10) + half(17)) % 10).cast("int").alias("node"))


@query("""SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'bolt']) AS hit, round(len(list_intersect(string_split(p_name, ' '), ['red', 'bolt'])) / CAST(len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'bolt']))) AS DOUBLE), 6) AS jaccard FROM part""")
def array_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, wanted = F.split("p_name", " "), F.array(F.lit("red"), F.lit("bolt"))
    return read(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(words, wanted).alias("hit"), F.round(scoring.jaccard(words, wanted), 6).alias("jaccard"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT c.user_id, round(sum(c.n * t.n) / sqrt(sum(c.n * c.n)) / (SELECT sqrt(sum(n * n)) FROM t), 6) AS cosine FROM c JOIN t USING (event_type) GROUP BY 1""")
def profile_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of a user's counts of types with the overall ones, both as maps."""
    rows = events(spark, sf_dir)
    to_map = lambda df: F.map_from_entries(F.collect_list(F.struct("event_type", "n")))
    own = rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    overall = own.groupBy("event_type").agg(F.sum("n").alias("n")).agg(to_map(None).alias("all"))
    return own.groupBy("user_id").agg(to_map(None).alias("m")).crossJoin(F.broadcast(overall)).select("user_id", F.round(scoring.cosine(F.col("m"), F.col("all")), 6).alias("cosine"))


@query("""SELECT event_id, json_object('event', event_id, 'kind', event_type, 'user', user_id) AS canonical, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order, no spaces."""
    row = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return events(spark, sf_dir).select("event_id", row.alias("canonical"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, CAST(value AS VARCHAR) AS v, lag(event_type) OVER w AS pt, lag(CAST(value AS VARCHAR)) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN pt IS DISTINCT FROM event_type THEN 1 ELSE 0 END + CASE WHEN pv IS DISTINCT FROM v THEN 1 ELSE 0 END AS changed FROM o""")
def field_delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ from the row before, by field maps."""
    from sparkloom.operators import delta

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fields = F.create_map(F.lit("type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", fields.alias("now"))
    changed = delta.changed(F.coalesce(F.lag("now").over(w), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.col("now"))
    return rows.select("event_id", F.size(changed).alias("changed"))


@query("""SELECT user_id, md5(string_agg(CAST(event_id AS VARCHAR) || ':' || event_type, '|' ORDER BY event_id)) AS chain FROM events GROUP BY 1""")
def chained_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]), "|")
    return events(spark, sf_dir).groupBy("user_id").agg(F.md5(ordered.cast("binary")).alias("chain"))


@query("""SELECT user_id, min(event_id) AS broken FROM events WHERE event_id % 97 = 5 GROUP BY 1""")
def hash_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains built over each user's rows, some rows changed afterwards, and checked again: the first place that doesn't fit."""
    from sparkloom.operators import delta

    rows = events(spark, sf_dir).select("user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string")).alias("body"))
    chains = delta.hash_chain(rows, "user_id", "event_id", "body")
    changed = chains.withColumn("body", F.when(F.col("event_id") % 97 == 5, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return delta.first_break(changed, "user_id", "event_id", "body")


@query("""SELECT strftime(ts, '%Y%m%d_') || lpad(CAST(hour(ts) // 6 * 6 AS VARCHAR), 2, '0') AS bucket, count(*) AS n FROM events GROUP BY 1""")
def time_bucket_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.concat(F.date_format("ts", "yyyyMMdd_"), F.lpad((F.floor(F.hour("ts") / 6) * 6).cast("string"), 2, "0"))
    return events(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE r AS (SELECT list(sha256(o_orderkey || '=' || o_orderstatus) ORDER BY o_orderkey) AS h FROM orders UNION ALL SELECT [sha256(h[i] || coalesce(h[i + 1], h[i])) FOR i IN range(1, len(h) + 1, 2)] FROM r WHERE len(h) > 1) SELECT h[1] AS root FROM r WHERE len(h) = 1""")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for all orders, that changes with any of them."""
    from sparkloom.operators import delta

    return delta.merkle_root(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 6)


_RING = ", ".join(f"({p}, '{n}')" for p, n in ring_points([f"node{i}" for i in range(5)], 64))


@query(f"""WITH r AS (SELECT * FROM (VALUES {_RING}) v(p, n)), k AS (SELECT c_custkey, CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) AS h FROM customer) SELECT c_custkey, coalesce(r.n, (SELECT arg_min(n, p) FROM r)) AS node FROM k ASOF LEFT JOIN r ON k.h < r.p""")
def consistent_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's node: the first point of the ring after the key's hash. The ring is a sorted array expression."""
    return read(spark, sf_dir, "customer").select("c_custkey", ring_node(F.col("c_name"), [f"node{i}" for i in range(5)], 64).alias("node"))


@query("""SELECT s_suppkey, round(0.5 * CASE WHEN s_acctbal > 5000 THEN 1 ELSE s_acctbal / 5000 END + 0.3 * (1 - abs(s_nationkey - 12) / 24.0) + 0.2 * CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END, 6) AS score FROM supplier""")
def multi_factor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    score = 0.5 * F.when(b > 5000, 1.0).otherwise(b / 5000) + 0.3 * scoring.proximity(F.col("s_nationkey"), F.lit(12), 24) + 0.2 * F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(0)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(score, 6).alias("score"))


@query("""SELECT page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, CASE WHEN contains(url, 'utm_') THEN 'campaign' WHEN contains(url, 'page=') THEN 'listing' WHEN contains(url, '.html') THEN 'article' ELSE 'other' END AS stage FROM pages""")
def url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    stage = F.when(url.contains("utm_"), "campaign").when(url.contains("page="), "listing").when(url.contains(".html"), "article").otherwise("other")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "/(en|de|fr|es)/", 1).alias("lang"), F.nullif(F.regexp_extract(url, "/([0-9]+)", 1), F.lit("")).cast("long").alias("number"), stage.alias("stage"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey * 7919 % 10 < 3""")
def stable_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable form of a random split: by the key, the same at every run."""
    return read(spark, sf_dir, "customer").where("c_custkey * 7919 % 10 < 3").select("c_custkey")
