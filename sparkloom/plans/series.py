"""Windows over time series, anomaly scores, forecasts, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered, series, stats
from sparkloom.plans.registry import events, query, seconds

_DAILY = "WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n, avg(value) AS mean, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(seconds("ts") / 86400)
    return events(spark, sf_dir).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors")).withColumn("series", F.lit("all"))


@query("""SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 4) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) QUALIFY count(value) OVER w >= 2 AND stddev_samp(value) OVER w > 1e-9 AND abs((value - avg(value) OVER w) / stddev_samp(value) OVER w) > 2.5""")
def rolling_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = series.rolling_z("value", "user_id", "ts", "event_id")
    return events(spark, sf_dir).withColumn("z", z).where(F.abs("z") > 2.5).select("event_id", F.round("z", 4).alias("z"))


@query("""SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 4) AS z FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) QUALIFY count(value) OVER w >= 2 AND stddev_pop(value) OVER w > 1e-9 AND abs((value - avg(value) OVER w) / stddev_pop(value) OVER w) > 2.5""")
def rolling_z_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys for all rows: windows over chunks of a key's rows, each behind copies of the 50 before it."""
    rows = events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    chunked = ordered.rolling_chunks(rows, ["event_type"], F.floor(seconds("ts") / 3600), ["ts", "event_id"], 50).withColumn("key", F.struct("event_type", "chunk"))
    z = series.rolling_z("value", "key", "ts", "event_id", window=50, population=True)
    return chunked.withColumn("z", z).where(F.col("real") & (F.abs("z") > 2.5)).select("event_id", F.round("z", 4).alias("z"))


@query("""SELECT user_id, round(regr_slope(value, epoch_us(ts) / 1e6 / 86400), 6) AS slope, round(regr_r2(value, epoch_us(ts) / 1e6 / 86400), 6) AS r2 FROM events GROUP BY 1""")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = seconds("ts") / 86400
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(F.regr_slope("value", days), 6).alias("slope"), F.round(F.regr_r2("value", days), 6).alias("r2"))


@query(_DAILY + """ SELECT day, coalesce(n - lag(n) OVER w, 0) AS diff, round(CAST(n AS DOUBLE) / nullif(lag(n) OVER w, 0) - 1, 6) AS change, coalesce(n - 2 * lag(n) OVER w + lag(n, 2) OVER w, 0) AS second FROM d WINDOW w AS (ORDER BY day)""")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy("day")
    n, before = F.col("n"), F.lag("n").over(w)
    return daily(spark, sf_dir).select("day", F.coalesce(n - before, F.lit(0)).alias("diff"), F.round(n / F.nullif(before, F.lit(0)) - 1, 6).alias("change"), F.coalesce(n - 2 * before + F.lag("n", 2).over(w), F.lit(0)).alias("second"))


@query("""SELECT event_id, round(CASE WHEN count(*) OVER w = 10 THEN avg(value) OVER w END, 6) AS moving, round(CASE WHEN count(*) OVER w = 10 THEN stddev_samp(value) OVER w END, 6) AS spread, lag(value, 1) OVER o AS lag_1, lag(value, 5) OVER o AS lag_5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), o AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("value", "user_id", "ts", "event_id")
    lag = series.lags(*by, steps=(1, 5))
    return events(spark, sf_dir).select("event_id", F.round(series.moving_average(*by, window=10), 6).alias("moving"), F.round(series.rolling_std(*by, window=10), 6).alias("spread"), lag["lag_1"].alias("lag_1"), lag["lag_5"].alias("lag_5"))


@query("""SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS weekday, isodow(ts) >= 6 AS weekend, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos FROM events""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = 2 * F.pi() * F.hour("ts") / 24
    day = F.weekday("ts").cast("long")
    return events(spark, sf_dir).select("event_id", F.hour("ts").cast("long").alias("hour"), F.minute("ts").cast("long").alias("minute"), day.alias("weekday"), (day >= 5).alias("weekend"), (F.round(F.sin(turn), 6) + 0.0).alias("hour_sin"), (F.round(F.cos(turn), 6) + 0.0).alias("hour_cos"))


@query("""WITH h AS (SELECT event_id, value, avg(value) OVER (PARTITION BY hour(ts)) AS hm, stddev_pop(value) OVER (PARTITION BY hour(ts)) AS hs, avg(value) OVER (PARTITION BY isodow(ts)) AS dm, stddev_pop(value) OVER (PARTITION BY isodow(ts)) AS ds FROM events) SELECT event_id, round(greatest(abs(value - hm) / hs, abs(value - dm) / ds), 4) AS deviation FROM h WHERE greatest(abs(value - hm) / hs, abs(value - dm) / ds) > 3""")
def seasonal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger deviation from the hour's and the weekday's baseline. Baselines are pre-aggregated and joined: 24 and 7 rows."""
    rows = events(spark, sf_dir).select("event_id", "value", F.hour("ts").alias("h"), F.weekday("ts").alias("d"))
    hours = rows.groupBy("h").agg(F.avg("value").alias("hm"), F.stddev_pop("value").alias("hs"))
    days = rows.groupBy("d").agg(F.avg("value").alias("dm"), F.stddev_pop("value").alias("ds"))
    deviation = F.greatest(F.abs(F.col("value") - F.col("hm")) / F.col("hs"), F.abs(F.col("value") - F.col("dm")) / F.col("ds"))
    return rows.join(F.broadcast(hours), "h").join(F.broadcast(days), "d").where(deviation > 3).select("event_id", F.round(deviation, 4).alias("deviation"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, value AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, r.s * 0.7 + o.value * 0.3 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, round(arg_max(s, i), 6) AS ewma FROM r GROUP BY 1""")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In closed form over the last rows of a key."""
    return ordered.weighted(events(spark, sf_dir).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", 0.3).select("user_id", F.round("smoothed", 6).alias("ewma"))


@query("""WITH RECURSIVE c AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), o AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM c),
    r AS (SELECT a.event_type, CAST(1 AS BIGINT) AS i, a.n AS level, b.n - a.n AS slope FROM o a JOIN o b ON a.event_type = b.event_type AND a.i = 1 AND b.i = 2 UNION ALL SELECT o.event_type, o.i, 0.5 * o.n + 0.5 * (r.level + r.slope), 0.3 * (0.5 * o.n + 0.5 * (r.level + r.slope) - r.level) + 0.7 * r.slope FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1)
    SELECT event_type, round(greatest(arg_max(level, i) + 3 * arg_max(slope, i), 0), 6) AS forecast FROM r GROUP BY 1""")
def holt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events(spark, sf_dir).groupBy("event_type", F.floor(seconds("ts") / 86400).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("day", "n"))), lambda x: x["n"])
    return counted.groupBy("event_type").agg(ordered.alias("v")).select("event_type", F.round(series.holt(F.col("v"), 0.5, 0.3, 3), 6).alias("forecast"))


@query("""WITH h AS (SELECT hour(ts) AS hour, avg(value) AS a FROM events GROUP BY 1), o AS (SELECT avg(value) AS m FROM events) SELECT hour, round(least(greatest(a / m, 0.5), 2.0), 6) AS factor FROM h, o""")
def seasonality_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    hours = rows.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.avg("value").alias("a"))
    overall = rows.agg(F.avg("value").alias("m"))
    return hours.crossJoin(F.broadcast(overall)).select("hour", F.round(F.least(F.greatest(F.col("a") / F.col("m"), F.lit(0.5)), F.lit(2.0)), 6).alias("factor"))


@query(_DAILY + """, m AS (SELECT avg(n) AS m, var_pop(n) * count(*) AS t FROM d) SELECT CAST(l AS BIGINT) AS lag, round(sum((a.n - m) * (b.n - m)) / any_value(t), 6) AS r FROM range(1, 11) x(l), d a, d b, m WHERE b.day = a.day - l GROUP BY 1""")
def autocorrelations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.autocorrelation(daily(spark, sf_dir), "day", "n", 1, 10)
    return found.select(F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"))


@query(_DAILY + """ SELECT CAST(l AS BIGINT) AS lag, round(corr(a.mean, b.n), 6) AS r, count(*) AS n FROM range(-5, 6) x(l), d a, d b WHERE b.day = a.day + l GROUP BY 1""")
def lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.lagged_correlation(daily(spark, sf_dir).select("day", "mean", "n"), "day", "mean", "n", 5)
    return found.select(F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"), "n")


@query("""SELECT round(corr(value, k), 6) AS pearson, round(corr(rv, rk), 6) AS spearman FROM (SELECT value, k, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rv, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS rk FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))""")
def pearson_and_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ranks come from counts of distinct values, so only those are ordered, not the rows."""
    rows = events(spark, sf_dir).select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))

    def ranks(c: str) -> DataFrame:
        counted = rows.groupBy(c).agg(F.count(F.lit(1)).alias("m"))
        upto = F.sum("m").over(Window.partitionBy(F.lit(1)).orderBy(c))
        return counted.select(c, (upto - F.col("m") + 1 + (F.col("m") - 1) / 2.0).alias(f"r_{c}"))

    ranked = rows.join(ranks("value"), "value").join(ranks("k"), "k")
    return ranked.agg(F.round(F.corr("value", "k"), 6).alias("pearson"), F.round(F.corr("r_value", "r_k"), 6).alias("spearman"))


@query("""WITH b AS (SELECT min(value) AS l1, max(value) AS h1, min(k) AS l2, max(k) AS h2 FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)), c AS (SELECT least(floor((value - l1) / (h1 - l1) * 8), 7) AS x, least(floor((CAST(json_extract_string(props, '$.k') AS DOUBLE) - l2) / (h2 - l2) * 8), 7) AS y, count(*) AS n FROM events, b GROUP BY 1, 2),
    p AS (SELECT x, y, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM c) SELECT round(sum(p * ln(p / (px * py))), 6) AS mi, round(sum(p * ln(p / (px * py))) / least(-sum(p * ln(px)), -sum(p * ln(py))), 6) AS normalised FROM p""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return stats.mutual_information(rows, "value", "k").select(F.round("mi", 6).alias("mi"), F.round("normalised", 6).alias("normalised"))


@query("""WITH p AS (SELECT user_id, count(*) / 1e4 + user_id / 1e3 AS p FROM events GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM p) SELECT user_id, round(least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 8) AS adjusted, least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) <= 0.05 AS significant FROM r""")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = events(spark, sf_dir).groupBy("user_id").agg((F.count(F.lit(1)) / 1e4 + F.col("user_id") / 1e3).alias("p"))
    return stats.benjamini_hochberg(tests, "p", 0.05).select("user_id", F.round("adjusted", 8).alias("adjusted"), "significant")


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 6) AS failures FROM events""")
def sliding_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return rows.select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("n"), F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).over(w), 6).alias("failures"))


@query("""SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value * value), 6) AS squares, round(var_pop(value), 6) AS variance FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_format(F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"], "yyyy-MM-dd HH:mm")
    return events(spark, sf_dir).groupBy(start.alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("squares"), F.round(F.var_pop("value"), 6).alias("variance"))


@query("""SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(b - o * 900 AS BIGINT)), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM (SELECT *, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS b FROM events), range(4) r(o) GROUP BY 1""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that begin each quarter of an hour."""
    start = F.date_format(F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes")["start"], "yyyy-MM-dd HH:mm")
    return events(spark, sf_dir).groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT event_id, g FROM (SELECT event_id, event_type || '>' || lead(event_type, 1) OVER w || '>' || lead(event_type, 2) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE g IS NOT NULL""")
def ordered_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("event_id", F.concat("event_type", F.lit(">"), F.lead("event_type", 1).over(w), F.lit(">"), F.lead("event_type", 2).over(w)).alias("g")).where("g is not null")


@query("""WITH g AS (SELECT user_id, event_type || '>' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), m AS (SELECT g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY 1), s AS (SELECT sum(n) AS t FROM m) SELECT user_id, round(avg(CASE WHEN n / t < 0.035 THEN 1.0 ELSE 0.0 END), 6) AS rarity FROM g JOIN m USING (g), s GROUP BY 1""")
def sequence_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    grams = events(spark, sf_dir).select("user_id", F.concat("event_type", F.lit(">"), F.lead("event_type").over(w)).alias("g")).where("g is not null")
    model = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    total = model.agg(F.sum("n").alias("t"))
    return grams.join(model, "g").crossJoin(F.broadcast(total)).groupBy("user_id").agg(F.round(F.avg(F.when(F.col("n") / F.col("t") < 0.035, 1.0).otherwise(0.0)), 6).alias("rarity"))


@query("""SELECT event_type, round(stddev_pop(value) / avg(value), 6) AS variation, round(1 / (1 + stddev_pop(value) / avg(value)), 6) AS confidence, round(avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS completeness FROM events GROUP BY 1""")
def load_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = F.stddev_pop("value") / F.avg("value")
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(cv, 6).alias("variation"), F.round(1 / (1 + cv), 6).alias("confidence"), F.round(F.avg(F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)), 6).alias("completeness"))


@query("""WITH f AS (SELECT event_id, value, avg(value) OVER w5 AS a, avg(value) OVER w20 AS b FROM events WINDOW w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), e AS (SELECT *, 0.4 * a + 0.6 * b AS p FROM f WHERE a IS NOT NULL) SELECT count(*) AS n, round(avg(abs(value - p)), 6) AS mae, round(sqrt(avg(pow(value - p, 2))), 6) AS rmse FROM e""")
def ensemble_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecasts, blended with fixed weights, against what came."""
    over = lambda n: F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-n, -1))
    rows = events(spark, sf_dir).select("value", over(5).alias("a"), over(20).alias("b")).where("a is not null")
    error = F.col("value") - (0.4 * F.col("a") + 0.6 * F.col("b"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"))


@query("""WITH w AS (SELECT event_id, count(*) OVER p = 20 AND avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) OVER p < 0.65 AS drift FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)) SELECT drift, count(*) AS n FROM w GROUP BY 1""")
def drift_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    drift = (F.count(F.lit(1)).over(w) == 20) & (F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).over(w) < 0.65)
    return events(spark, sf_dir).select(drift.alias("drift")).groupBy("drift").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, event_type, count(*) > 0 AS on_ FROM events WHERE value > 40 GROUP BY 1, 2), p AS (SELECT a.event_type AS a, b.event_type AS b, count(*) AS common FROM m a JOIN m b ON a.h = b.h AND a.event_type < b.event_type GROUP BY 1, 2), c AS (SELECT event_type, count(*) AS n FROM m GROUP BY 1) SELECT a, b, round(common / CAST(x.n + y.n - common AS DOUBLE), 6) AS overlap FROM p JOIN c x ON x.event_type = a JOIN c y ON y.event_type = b""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the hours in which two types are present; a row for each type and hour is joined."""
    present = events(spark, sf_dir).where("value > 40").select(F.floor(seconds("ts") / 3600).alias("h"), "event_type").distinct()
    n = present.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = present.select("h", F.col("event_type").alias("a")).join(present.select("h", F.col("event_type").alias("b")), "h").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    sized = pairs.join(n.select(F.col("event_type").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("event_type").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("overlap"))
