"""Inverted indexes, compound tokens, synonyms, regions, tokens for secret values, deltas of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scoring
from sparkloom.operators import vocabulary
from sparkloom.plans.registry import events, query, read

_TERMS = ["license", "the", "of"]
_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(words)).alias("token"))


@query(f"""SELECT doc_id FROM documents WHERE list_has_all({_WORDS}, ['license', 'the', 'of'])""")
def posting_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all terms, from the shortest posting list on."""
    return vocabulary.with_all(_postings(spark, sf_dir), _TERMS)


@query(f"""SELECT doc_id FROM documents WHERE list_has_any({_WORDS}, ['license', 'copyright'])""")
def posting_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.with_any(_postings(spark, sf_dir), ["license", "copyright"])


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 3 AS newest FROM orders), t AS (SELECT o_orderkey, unnest(string_split(CASE newest WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN 'second ' || lower(o_orderpriority) ELSE 'third edition' END, ' ')) AS token FROM s) SELECT token, count(*) AS n FROM t GROUP BY 1""")
def segmented_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments of an index; what a later one has of an order replaces what earlier ones have."""
    orders, low = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.lower("o_orderpriority")
    segment = lambda rows, text: rows.select("o_orderkey", F.explode(F.split(text, " ")).alias("token"))
    segments = [segment(orders, low), segment(orders.where("o_orderkey % 3 >= 1"), F.concat(F.lit("second "), low)), segment(orders.where("o_orderkey % 3 = 2"), F.lit("third edition"))]
    return vocabulary.newest_segment(segments, "o_orderkey").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, len(w) AS length, len(list_distinct(w)) AS terms, len(list_filter(w, lambda x: x = 'the')) AS tf_the FROM w""")
def index_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index keeps of each document: its length, its number of terms, and a term's frequency."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = read(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("length"), F.size(F.array_distinct("w")).cast("long").alias("terms"), F.size(F.filter("w", lambda x: x == "the")).cast("long").alias("tf_the"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#\s:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#\s]+(.*)$', 1) AS tail FROM pages) SELECT DISTINCT page_id, unnest(list_filter(list_concat([host], string_split(host, '.'), string_split_regex(tail, '[^A-Za-z0-9_]+')), lambda x: x <> '')) AS token FROM p""")
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that a url is found by: the host, its labels, the words of path and query."""
    return read(spark, sf_dir, "pages").select("page_id", F.explode(vocabulary.parts_of_url(F.col("url"))).alias("token"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT regexp_replace(w, '^(.{3,}?)(ations?|ings?|ed|es|s|ly)$', '\\1') AS stem, count(*) AS n FROM t GROUP BY 1""")
def stemmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return words.groupBy(vocabulary.stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


_SYNONYMS = {"red": ["crimson", "scarlet", "ruby"], "bolt": ["screw", "red"], "small": ["tiny", "little"], "ring": ["band"]}


@query("""WITH s AS (SELECT * FROM (VALUES ('red', ['crimson', 'scarlet']), ('bolt', ['screw', 'red']), ('small', ['tiny', 'little']), ('ring', ['band'])) v(w, more)), t AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part),
    u AS (SELECT p_partkey, t, list_concat(coalesce(a.more, []), coalesce(b.more, [])) AS m FROM t LEFT JOIN s a ON a.w = t[1] LEFT JOIN s b ON b.w = t[2]) SELECT p_partkey, array_to_string(list_concat(t, list_filter(m, lambda x: NOT list_contains(t, x))[1:3]), ' ') AS query FROM u""")
def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two synonyms of a word and three in all."""
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(vocabulary.expanded(F.split("p_name", " "), _SYNONYMS, 2, 3), " ").alias("query"))


@query("""SELECT k AS key, count(*) AS n FROM (SELECT unnest(['ip:10.0.' || user_id % 7 || '.' || user_id % 5, CASE WHEN event_type = 'error' THEN '404_error:/p/' || event_id % 20 END, 'hour:' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0'), 'user_agent:' || event_type]) AS k FROM events) WHERE k IS NOT NULL GROUP BY 1""")
def security_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, missing pages, hours and agents as keys of one count."""
    u, e = F.col("user_id"), F.col("event_id")
    keys = F.array(
        F.concat(F.lit("ip:10.0."), (u % 7).cast("string"), F.lit("."), (u % 5).cast("string")),
        F.when(F.col("event_type") == "error", F.concat(F.lit("404_error:/p/"), (e % 20).cast("string"))),
        F.concat(F.lit("hour:"), F.date_format("ts", "HH")),
        F.concat(F.lit("user_agent:"), F.col("event_type")),
    )
    return events(spark, sf_dir).select(F.explode(keys).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# Prefixes of private addresses as the log tools have them.
PRIVATE = ("10.", "172.16.", "192.168.", "127.")


@query("""WITH i AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN '10.' WHEN 1 THEN '172.16.' ELSE '81.' END || user_id % 200 || '.7.' || user_id % 90 AS ip FROM events), r AS (SELECT user_id, CASE WHEN starts_with(ip, '10.') OR starts_with(ip, '172.16.') THEN 'Internal' ELSE 'region ' || CAST(((CAST('0x' || substr(md5(ip), 1, 16) AS UBIGINT) % 10) * 6 + CAST('0x' || substr(md5(ip), 17, 16) AS UBIGINT) % 10) % 10 AS VARCHAR) END AS region FROM i) SELECT region, count(*) AS n FROM r GROUP BY 1""")
def geo_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private addresses are internal, others go to one of ten regions by a hash."""
    u = F.col("user_id")
    head = F.when(u % 4 == 0, "10.").when(u % 4 == 1, "172.16.").otherwise("81.")
    ip = F.concat(head, (u % 200).cast("string"), F.lit(".7."), (u % 90).cast("string"))
    inside = F.lit(False)
    for prefix in PRIVATE:
        inside = inside | ip.startswith(prefix)
    region = F.when(inside, "Internal").otherwise(F.concat(F.lit("region "), scoring.md5_mod(ip, 10).cast("string")))
    return events(spark, sf_dir).groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"))


_GOOD, _BAD = ("ok", "up", "one", "sous", "with"), ("down", "fail", "error", "not", "pas")


@query(f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations), c AS (SELECT conv_id, turn, len(list_filter(w, lambda x: x IN {_GOOD})) AS good, len(list_filter(w, lambda x: x IN {_BAD})) AS bad FROM w) SELECT conv_id, turn, round((good - bad) / CAST(greatest(good + bad, 1) AS DOUBLE), 6) AS score, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS mood FROM c""")
def mood_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two lists, weighed against each other."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    count = lambda chosen: F.size(F.filter("w", lambda x: x.isin(*chosen)))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).select("conv_id", "turn", count(_GOOD).alias("good"), count(_BAD).alias("bad"))
    mood = F.when(F.col("good") > F.col("bad"), "positive").when(F.col("bad") > F.col("good"), "negative").otherwise("neutral")
    return c.select("conv_id", "turn", F.round((F.col("good") - F.col("bad")) / F.greatest(F.col("good") + F.col("bad"), F.lit(1)), 6).alias("score"), mood.alias("mood"))


@query("""SELECT c_custkey, 'tok_' || substr(sha256('key' || chr(31) || c_name), 1, 32) AS token, c_name AS value FROM customer""")
def token_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names replaced by tokens, and read back through the table of tokens."""
    rows = read(spark, sf_dir, "customer")
    hidden = rows.select("c_custkey", vocabulary.token_of(F.col("c_name"), "key").alias("token"))
    return hidden.join(vocabulary.vault(rows, "c_name", "key"), "token").select("c_custkey", "token", "value")


@query("""SELECT * FROM (VALUES ('c_name', 'name'), ('c_acctbal', 'acct'), ('s_name', 'name'), ('s_acctbal', 'acct'), ('p_name', 'name'), ('n_name', 'name'), ('r_name', 'name'), ('user_id', 'user'), ('o_custkey', 'cust'), ('c_custkey', 'cust')) v(field, kind)""")
def sensitive_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose names contain a sensitive word, the first word of the list that does."""
    words = ("name", "acct", "user", "cust")
    columns = [c for t in ("customer", "supplier", "part", "nation", "region", "events", "orders") for c in read(spark, sf_dir, t).columns]
    hits = [(c, next(w for w in words if w in c.lower())) for c in dict.fromkeys(columns) if any(w in c.lower() for w in words)]
    return spark.createDataFrame(hits, "field string, kind string")


@query("""WITH p AS (SELECT p_partkey, p_name AS now, lag(p_name) OVER (PARTITION BY p_partkey % 16 ORDER BY p_partkey) AS b FROM part), d AS (SELECT p_partkey, now, b, len(list_filter(range(1, least(length(now), length(b)) + 1), lambda i: left(now, CAST(i AS BIGINT)) = left(b, CAST(i AS BIGINT)))) AS prefix FROM p WHERE b IS NOT NULL) SELECT p_partkey, prefix, now AS restored FROM d""")
def text_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name as what it shares with the one before at both ends and what is new, and restored from that."""
    before = F.lag("p_name").over(Window.partitionBy(F.col("p_partkey") % 16).orderBy("p_partkey"))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", before.alias("b")).where("b is not null")
    d = rows.withColumn("d", vocabulary.text_delta(F.col("b"), F.col("p_name")))
    return d.select("p_partkey", F.col("d.prefix").cast("long").alias("prefix"), vocabulary.patched(F.col("b"), F.col("d")).alias("restored"))


@query("""WITH n AS (SELECT n_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) AS strict FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
    r AS (SELECT c_nationkey, c_custkey, c_mktsegment = 'BUILDING' AND c_acctbal > 9000 AS fits, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS rank FROM customer)
    SELECT c_nationkey AS nation, c_custkey, fits, rank FROM r JOIN n ON n_nationkey = c_nationkey WHERE rank <= 3 AND (fits OR strict < 3)""")
def widening_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates for each nation: those that pass hard filters, and only if they are too few the best of the others behind them."""
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)).alias("fits"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("fits"), F.desc("c_acctbal"), "c_custkey")
    best = c.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return best.select(F.col("c_nationkey").alias("nation"), "c_custkey", "fits", F.col("rank").cast("long").alias("rank"))
