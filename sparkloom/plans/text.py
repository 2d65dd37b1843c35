"""Text: parsing, masking, redaction, search and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.operators import search
from sparkloom.plans.registry import query, read
from sparkloom.sources import lines

_MASKED = "text"
for _pattern, _name in text.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '{_name}', 'g')"
_LINES = "(SELECT item_id, unnest(string_split(text, '. ')) AS text FROM benchmark)"


@query(f"""SELECT md5(trim(regexp_replace({_MASKED}, '\\s+', ' ', 'g'))) AS template, count(*) AS n FROM documents GROUP BY 1""")
def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by their masked template; digests, as texts are long."""
    docs = read(spark, sf_dir, "documents").select(F.md5(text.template(F.col("text")).cast("binary")).alias("template"))
    return docs.groupBy("template").agg(F.count(F.lit(1)).alias("n"))


_EXTRACT = "len(regexp_extract_all(text, '{}'))"


@query(f"""SELECT doc_id, {_EXTRACT.format(text.EMAIL)} AS emails, {_EXTRACT.format(text.PHONE)} AS phones, {_EXTRACT.format(text.SSN)} AS ssns, {_EXTRACT.format(text.CARD)} AS cards, {_EXTRACT.format(text.IPV4)} AS ips FROM documents""")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.size(text.found(F.col("text"), p)).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", n(text.EMAIL).alias("emails"), n(text.PHONE).alias("phones"), n(text.SSN).alias("ssns"), n(text.CARD).alias("cards"), n(text.IPV4).alias("ips"))


_REDACTED = "text"
for _pattern, _name in ((text.EMAIL, "[EMAIL]"), (text.SSN, "[SSN]"), (text.CARD, "[CARD]"), (text.PHONE, "[PHONE]")):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_name}', 'g')"


@query(f"""SELECT doc_id, md5({_REDACTED}) AS redacted, length({_REDACTED}) AS n FROM documents""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.redacted(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(out.cast("binary")).alias("redacted"), F.length(out).cast("long").alias("n"))


@query(f"""SELECT doc_id, v AS address, '*' || substr(v, 2) AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{text.EMAIL}')) AS v FROM documents)""")
def found_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.found(F.col("text"), text.EMAIL)).alias("address"))
    return rows.withColumn("masked", F.concat(F.lit("*"), F.expr("substring(address, 2)")))


_LUHN = "CAST(d[17 - i] AS INTEGER)"


@query(f"""WITH c AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{text.CARD}')), '[- ]', '', 'g') AS d FROM documents),
    l AS (SELECT doc_id, d, list_sum([CASE WHEN i % 2 = 1 THEN {_LUHN} WHEN {_LUHN} > 4 THEN 2 * {_LUHN} - 9 ELSE 2 * {_LUHN} END FOR i IN range(1, 17)]) AS s FROM c) SELECT doc_id, repeat('*', 12) || right(d, 4) AS card FROM l WHERE s % 10 = 0""")
def valid_card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-like numbers that pass the checksum."""
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.found(F.col("text"), text.CARD)).alias("card"))
    digits = F.regexp_replace("card", "[- ]", "")
    return found.where(scoring.luhn(digits)).select("doc_id", text.partly_masked(digits).alias("card"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_POSTINGS = f"WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_STOP}))) AS token FROM documents), p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1), d AS (SELECT token, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM l)"


@query(_POSTINGS + " SELECT token, df FROM d")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(_POSTINGS + " SELECT doc_id, token, round(tf / len * ln(n / CAST(df AS DOUBLE)), 8) AS score FROM p JOIN l USING (doc_id) JOIN d USING (token), n")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tf_idf(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "token", F.round("score", 8).alias("score"))


@query(_POSTINGS + " SELECT doc_id, round(sum(tf / len * (ln((n + 1) / CAST(df + 1 AS DOUBLE)) + 1)), 8) AS score, count(*) AS matched FROM p JOIN l USING (doc_id) JOIN d USING (token), n WHERE token IN ('tion', 'ing', 'ther', 'en') GROUP BY 1 ORDER BY matched DESC, score DESC, doc_id LIMIT 10")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read(spark, sf_dir, "documents"), "doc_id", "text", ["tion", "ing", "ther", "en"], 10).withColumn("score", F.round("score", 8))


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the ') EXCEPT SELECT doc_id FROM documents WHERE contains(lower(text), 'which')""")
def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return read(spark, sf_dir, "documents").where(F.contains(t, F.lit("tion")) & F.contains(t, F.lit("the ")) & ~F.contains(t, F.lit("which"))).select("doc_id").distinct()


@query("""SELECT token, n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token, count(*) AS n FROM documents GROUP BY 1) WHERE starts_with(token, 'th') ORDER BY n DESC, token LIMIT 8""")
def prefix_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("token"))
    return words.where(F.startswith("token", F.lit("th"))).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(8)


@query("""SELECT doc_id, regexp_replace(text, '(?i)(tion|the)', '<mark>\\1</mark>', 'g') AS marked FROM documents""")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.highlighted(F.col("text"), ["tion", "the"]).alias("marked"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'license' WHEN regexp_matches(text, '[!#$%&*]{3}') THEN 'junk' WHEN length(text) < 300 THEN 'short' ELSE 'general' END AS intent FROM documents""")
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that fits, in order."""
    t = F.col("text")
    label = F.when(t.rlike("(?i)license|copyright"), "license").when(t.rlike("[!#$%&*]{3}"), "junk").when(F.length(t) < 300, "short").otherwise("general")
    return read(spark, sf_dir, "documents").select("doc_id", label.alias("intent"))


@query("""SELECT role, count(*) AS turns, round(avg(length(text)), 4) AS mean_length, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def conversation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg(F.length("text")), 4).alias("mean_length"), F.max("turn").alias("last_turn"))


@query("""SELECT lang, token, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rn FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS token FROM documents) GROUP BY 1, 2)) WHERE rn <= 10""")
def trending_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("token"))
    counted = words.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("rn <= 10").drop("rn")


_ACCESS = """'10.0.' || (event_id % 256) || '.' || (user_id % 256) || ' - u' || user_id || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /api/v' || (event_id % 3) || '/' || event_type || ' HTTP/1.1" ' || CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END || ' ' || CASE WHEN event_id % 5 = 0 THEN '-' ELSE CAST(event_id AS VARCHAR) END"""


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log lines made of the events."""
    from sparkloom.plans.registry import events

    s = lambda c: F.col(c).cast("string")
    status = F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "signup", "404").otherwise("200")
    size = F.when(F.col("event_id") % 5 == 0, "-").otherwise(s("event_id"))
    line = F.concat(F.lit("10.0."), (F.col("event_id") % 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"), F.lit(" - u"), s("user_id"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /api/v'), (F.col("event_id") % 3).cast("string"), F.lit("/"), "event_type", F.lit(' HTTP/1.1" '), status, F.lit(" "), size)
    return events(spark, sf_dir).select("event_id", line.alias("line"))


@query(f"""WITH l AS (SELECT event_id, {_ACCESS} AS line FROM events) SELECT event_id, regexp_extract(line, '^(\\S+)', 1) AS host, regexp_extract(line, ' - (\\S+)', 1) AS app, CAST(regexp_extract(line, '" (\\d{{3}}) ', 1) AS INT) AS status, coalesce(TRY_CAST(nullif(regexp_extract(line, '(\\S+)$', 1), '-') AS BIGINT), -1) AS bytes, CASE regexp_extract(line, '" (\\d)', 1) WHEN '5' THEN 'ERROR' WHEN '4' THEN 'WARN' ELSE 'INFO' END AS level, strftime(strptime(regexp_extract(line, '\\[([^ ]+)', 1), '%d/%b/%Y:%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS ts, 'common' AS format, regexp_extract(line, '"(GET [^ ]+)', 1) AS message FROM l""")
def parsed_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_lines(spark, sf_dir).select("event_id", lines.detect(F.col("line")).alias("r")).select("event_id", "r.*").select("event_id", "host", "app", "status", F.coalesce("bytes", F.lit(-1)).alias("bytes"), "level", "ts", "format", "message")


@query("""SELECT 'v' || (event_id % 3) AS version, count(*) AS n, round(100.0 * count(*) FILTER (WHERE event_type IN ('error', 'signup')) / count(*), 4) AS failed FROM events GROUP BY 1""")
def api_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lines.access(F.col("line"))
    parsed = access_lines(spark, sf_dir).select(row.alias("r"))
    version = F.concat(F.lit("v"), F.regexp_extract("r.message", r"/api/v(\d+)/", 1))
    return parsed.groupBy(version.alias("version")).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("r.status") >= 400) / F.count(F.lit(1)), 4).alias("failed"))


@query("""SELECT format, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'rfc3164' WHEN 2 THEN 'rfc5424' ELSE 'unknown' END AS format FROM events) GROUP BY 1""")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in several formats, each recognised by the first parser that fits."""
    from sparkloom.plans.registry import events

    kind = F.col("event_id") % 4
    t = F.date_format("ts", "MMM dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = (
        F.when(kind == 0, F.concat(F.lit('{"level":"info","msg":"'), "event_type", F.lit('"}')))
        .when(kind == 1, F.concat(F.lit("<34>"), t, F.lit(" host1 app[12]: "), "event_type"))
        .when(kind == 2, F.concat(F.lit("<165>1 "), iso, F.lit(' host2 app 77 ID47 [ex@1 k="v"] '), "event_type"))
        .otherwise(F.concat(F.lit("plain "), "event_type"))
    )
    return events(spark, sf_dir).select(lines.detect(line)["format"].alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), n AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT 20),
    s AS (SELECT n.vec_id AS query, v.vec_id AS id, round(list_dot_product(v.e, n.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(n.e, n.e))), 6) AS cosine, v.label = n.label AS same FROM v JOIN n ON v.vec_id <> n.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s) SELECT query, id, cosine, same, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def similar_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest earlier vectors by cosine for the newest ones, with the label's blend."""
    return search.similar(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", newest=20, k=5)
