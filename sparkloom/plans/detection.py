"""Sessions' scores, votes of detectors, thresholds that adapt, groups of alike anomalies, blended forecasts, seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered, series
from sparkloom.plans.registry import events, query, seconds

_SESSIONS = """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 14400 THEN 0 ELSE 1 END AS new FROM e),
    c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
    s AS (SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(t) - min(t) AS d, count(DISTINCT event_type) AS kinds, max(CASE event_type WHEN 'purchase' THEN 15 WHEN 'signup' THEN 10 WHEN 'click' THEN 1 ELSE 0 END) AS depth, bool_or(event_type IN ('purchase', 'signup')) AS buys, bool_or(event_type = 'click') AS looks FROM c GROUP BY 1, 2)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, session, n, d seconds, kinds, depth in the funnel, buys, looks) of sessions with gaps of at most four hours."""
    kind = F.col("event_type")
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", seconds("ts").alias("t"))
    depth = F.when(kind == "purchase", 15).when(kind == "signup", 10).when(kind == "click", 1).otherwise(0)
    return series.sessions(rows, "user_id", "t", 14400.0, "event_id").groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("d"), F.countDistinct("event_type").alias("kinds"), F.max(depth).alias("depth"),
        F.bool_or(kind.isin("purchase", "signup")).alias("buys"), F.bool_or(kind == "click").alias("looks"),
    )


@query(_SESSIONS + """ SELECT user_id, session, round(least(100, greatest(0, 30 * ln(1 + n) / ln(51) + CASE WHEN d < 30 THEN 30 * (d / 30) * 0.3 WHEN d <= 900 THEN 30 * (d / 900) ELSE 30 * (1 - 0.2 * least(1, (d - 900) / 3600)) END + 25 * least(1, kinds / 6.0) + depth)), 4) AS quality FROM s""")
def session_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 100 from the number of events, the duration, the variety of events and the depth reached in the funnel."""
    n, d = F.col("n"), F.col("d")
    duration = F.when(d < 30, 30 * (d / 30) * 0.3).when(d <= 900, 30 * (d / 900)).otherwise(30 * (1 - 0.2 * F.least(F.lit(1.0), (d - 900) / 3600)))
    total = 30 * F.log1p(n) / F.log(F.lit(51.0)) + duration + 25 * F.least(F.lit(1.0), F.col("kinds") / 6) + F.col("depth")
    return _sessions(spark, sf_dir).select("user_id", "session", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 4).alias("quality"))


@query(_SESSIONS + """ SELECT user_id, session, round(least(100, CASE WHEN n / greatest(d / 60, 0.01) > 20 THEN least(60, (n / greatest(d / 60, 0.01) - 20) * 3) ELSE 0 END + CASE WHEN d > 7200 THEN least(40, (d - 7200) / 180) ELSE 0 END), 4) AS anomaly FROM s""")
def session_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than 20 events a minute and more than two hours are suspicious."""
    d = F.col("d")
    velocity = F.col("n") / F.greatest(d / 60, F.lit(0.01))
    fast = F.when(velocity > 20, F.least(F.lit(60.0), (velocity - 20) * 3)).otherwise(0.0)
    long = F.when(d > 7200, F.least(F.lit(40.0), (d - 7200) / 180)).otherwise(0.0)
    return _sessions(spark, sf_dir).select("user_id", "session", F.round(F.least(F.lit(100.0), fast + long), 4).alias("anomaly"))


@query(_SESSIONS + """ SELECT CASE WHEN buys THEN 'purchasing' WHEN looks THEN 'searching' ELSE 'browsing' END AS type, count(*) AS sessions, round(avg(n), 6) AS mean_events FROM s GROUP BY 1""")
def session_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buying beats searching beats browsing."""
    kind = F.when(F.col("buys"), "purchasing").when(F.col("looks"), "searching").otherwise("browsing")
    return _sessions(spark, sf_dir).groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("n"), 6).alias("mean_events"))


@query("""WITH u AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1), h AS (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1),
    d AS (SELECT event_id, CASE WHEN u.n >= 5 THEN least(1, abs(value - m) / s / 4) END AS a, 1 - h.n / CAST(max(h.n) OVER () AS DOUBLE) AS b, CASE WHEN event_id % 3 <> 0 THEN value / 100 END AS c FROM events JOIN u USING (user_id) JOIN h ON h.h = hour(ts))
    SELECT event_id, round(greatest(0, least(1, (coalesce(a * 0.5, 0) + b * 0.2 + coalesce(c * 0.3, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + 0.2 + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END))), 6) AS confidence FROM d""")
def ensemble_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detectors with weights, renormalised over those that are ready (have enough rows, have a measure)."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "value", F.hour("ts").alias("h"))
    users = rows.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n"))
    hours = rows.groupBy("h").agg(F.count(F.lit(1)).alias("hn"))
    hours = hours.crossJoin(hours.agg(F.max("hn").alias("top"))).select("h", (1 - F.col("hn") / F.col("top")).alias("b"))  # 24 rows
    scored = rows.join(users, "user_id").join(F.broadcast(hours), "h").select(
        "event_id", "b", F.when(F.col("n") >= 5, F.least(F.lit(1.0), F.abs(F.col("value") - F.col("m")) / F.col("s") / 4)).alias("a"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 100).alias("c"),
    )
    weights = {"a": 0.5, "b": 0.2, "c": 0.3}
    total = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    ready = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return scored.select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / ready)), 6).alias("confidence"))


@query("""WITH c AS (SELECT event_id, hour(ts) = 3 AS maintenance, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) SELECT event_id, round(CAST(greatest(0.5, least(1.5, CASE WHEN seen < 3 THEN 1.3 WHEN seen > 50 THEN 0.7 ELSE 1.0 END * CASE WHEN maintenance THEN 0.6 ELSE 1.0 END)) AS DOUBLE), 4) AS factor FROM c""")
def context_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New users are more suspicious, frequent ones and hours of maintenance less."""
    seen = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = events(spark, sf_dir).select("event_id", (F.hour("ts") == 3).alias("maintenance"), seen.alias("seen"))
    factor = F.when(F.col("seen") < 3, 1.3).when(F.col("seen") > 50, 0.7).otherwise(1.0) * F.when(F.col("maintenance"), 0.6).otherwise(1.0)
    return rows.select("event_id", F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.5), factor)), 4).alias("factor"))


@query("""WITH RECURSIVE o AS (SELECT user_id, CASE WHEN value > 40 AND event_type <> 'error' THEN 1.0 ELSE 0.0 END AS wrong, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, i, CAST(0.1 * wrong AS DOUBLE) AS rate, CAST(greatest(0.3, least(0.9, 0.6 + CASE WHEN 0.1 * wrong > 0.05 THEN 0.01 WHEN 0.1 * wrong < 0.025 THEN -0.01 ELSE 0 END)) AS DOUBLE) AS threshold FROM o WHERE i = 1
    UNION ALL SELECT o.user_id, o.i, 0.1 * o.wrong + 0.9 * r.rate, greatest(0.3, least(0.9, r.threshold + CASE WHEN 0.1 * o.wrong + 0.9 * r.rate > 0.05 THEN 0.01 WHEN 0.1 * o.wrong + 0.9 * r.rate < 0.025 THEN -0.01 ELSE 0 END)) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
    SELECT user_id, round(arg_max(threshold, i), 4) AS threshold, round(arg_max(rate, i), 6) AS rate FROM r GROUP BY 1""")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smoothed rate of false alarms moves each user's threshold by a step, within bounds: a fold over ordered rows."""
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", F.when((F.col("value") > 40) & (F.col("event_type") != "error"), 1.0).otherwise(0.0).alias("wrong"))

    def step(state, row):  # noqa: ANN001, ANN202
        n, rate, threshold = state
        rate = 0.1 * row["wrong"] + 0.9 * rate
        threshold = max(0.3, min(0.9, threshold + (0.01 if rate > 0.05 else -0.01 if rate < 0.025 else 0)))
        return (n + 1, rate, threshold), (row["user_id"], n, rate, threshold)

    states = ordered.folded(rows, ["user_id"], ["ts", "event_id"], lambda: (0, 0.0, 0.6), step, "user_id long, n long, rate double, threshold double", ["wrong"])
    last = states.groupBy("user_id").agg(F.max(F.struct("n", "threshold", "rate")).alias("s"))
    return last.select("user_id", F.round("s.threshold", 4).alias("threshold"), F.round("s.rate", 6).alias("rate"))


@query("""WITH RECURSIVE o AS (SELECT user_id % 10 AS subnet, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id) AS i FROM events WHERE value > 20),
    r AS (SELECT subnet, event_type, i, t AS seed, 1 AS grp FROM o WHERE i = 1 UNION ALL SELECT o.subnet, o.event_type, o.i, CASE WHEN o.t - r.seed > 7200000000 THEN o.t ELSE r.seed END, CASE WHEN o.t - r.seed > 7200000000 THEN r.grp + 1 ELSE r.grp END FROM r JOIN o ON o.subnet = r.subnet AND o.event_type = r.event_type AND o.i = r.i + 1)
    SELECT subnet, event_type, CAST(grp AS BIGINT) AS grp, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def anomaly_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of one subnet and kind: a seed and all within two hours of it, then the next that is left."""
    rows = events(spark, sf_dir).where("value > 20").select((F.col("user_id") % 10).alias("subnet"), "event_type", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))

    def step(state, row):  # noqa: ANN001, ANN202
        seed, group = state
        if seed is None or row["t"] - seed > 7_200_000_000:
            seed, group = row["t"], group + 1
        return (seed, group), (row["subnet"], row["event_type"], group)

    found = ordered.folded(rows, ["subnet", "event_type"], ["ts", "event_id"], lambda: (None, 0), step, "subnet long, event_type string, grp long", ["t"])
    return found.groupBy("subnet", "event_type", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE p AS (SELECT event_type AS a, lead(event_type) OVER w AS b, epoch_us(ts) AS t, event_id, 1 / (1 + (lead(epoch_us(ts)) OVER w - epoch_us(ts)) / 3.6e9) AS strength FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, strength, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY t, event_id) AS i FROM p WHERE b IS NOT NULL),
    r AS (SELECT a, b, i, strength AS s FROM o WHERE i = 1 UNION ALL SELECT o.a, o.b, o.i, r.s + 0.2 * (o.strength - r.s) FROM r JOIN o ON o.a = r.a AND o.b = r.b AND o.i = r.i + 1)
    SELECT a, b, round(arg_max(s, i), 6) AS strength FROM r GROUP BY 1, 2""")
def source_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed strength of each pair of sources (kinds that follow each other), the first observation as it is."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    after = F.lead("event_type").over(w)
    rows = events(spark, sf_dir).select(F.col("event_type").alias("x"), after.alias("y"), t.alias("t"), "event_id", (1 / (1 + (F.lead(t).over(w) - t) / 3.6e9)).alias("strength")).where("y is not null")
    pairs = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "t", "event_id", "strength")
    return ordered.weighted(pairs, ["a", "b"], ["t", "event_id"], "strength", 0.2).select("a", "b", F.round("smoothed", 6).alias("strength"))


_FORECASTS = """WITH f AS (SELECT user_id, event_id, value, lag(value) OVER o AS one, avg(value) OVER w5 AS five, avg(value) OVER w20 AS twenty, stddev_pop(value) OVER w5 AS s5, stddev_pop(value) OVER w20 AS s20 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value with the forecasts of three models: the last value, the means of the last 5 and 20."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = lambda n: by.rowsBetween(-n, -1)
    return events(spark, sf_dir).select(
        "user_id", "event_id", "value", F.lag("value").over(by).alias("one"), F.avg("value").over(last(5)).alias("five"), F.avg("value").over(last(20)).alias("twenty"),
        F.stddev_pop("value").over(last(5)).alias("s5"), F.stddev_pop("value").over(last(20)).alias("s20"),
    )


@query(_FORECASTS + """, a AS (SELECT 1 / (1 + avg(abs(value - one))) AS one, 1 / (1 + avg(abs(value - five))) AS five, 1 / (1 + avg(abs(value - twenty))) AS twenty FROM f WHERE one IS NOT NULL),
    w AS (SELECT unnest(['one', 'five', 'twenty', 'new']) AS model, unnest([0.2 * one, 0.3 * five, 0.4 * twenty, 0.1 * 0.5]) AS w FROM a) SELECT model, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior weights times recent accuracy, a neutral one for a model without history, renormalised."""
    f = _forecasts(spark, sf_dir).where("one is not null")
    accuracy = f.agg(*((1 / (1 + F.avg(F.abs(F.col("value") - F.col(m))))).alias(m) for m in ("one", "five", "twenty"))).withColumn("new", F.lit(0.5))
    priors = {"one": 0.2, "five": 0.3, "twenty": 0.4, "new": 0.1}
    parts = {m: F.col(m) * w for m, w in priors.items()}
    total = sum(parts.values(), F.lit(0.0))
    return accuracy.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.round(p / total, 6).alias("weight")) for m, p in parts.items()))).alias("x")).select("x.*")


@query(_FORECASTS + """ SELECT event_id, round(coalesce((0.4 * (five - 2 * s5) + 0.6 * (twenty - 2 * s20)), one), 6) AS lower, round(coalesce((0.4 * (five + 2 * s5) + 0.6 * (twenty + 2 * s20)), one), 6) AS upper FROM f WHERE one IS NOT NULL""")
def combined_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of two models blended by their weights; the forecast itself where there are none."""
    bound = lambda sign: F.round(F.coalesce(0.4 * (F.col("five") + sign * 2 * F.col("s5")) + 0.6 * (F.col("twenty") + sign * 2 * F.col("s20")), F.col("one")), 6)
    return _forecasts(spark, sf_dir).where("one is not null").select("event_id", bound(-1).alias("lower"), bound(1).alias("upper"))


@query(_FORECASTS + """ SELECT event_id, round((one / 1 + five / 5 + twenty / 20) / (1 + 0.2 + 0.05), 6) AS blended FROM f WHERE one IS NOT NULL""")
def multi_window_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast for each length of window, blended: short windows weigh more."""
    lengths = {"one": 1, "five": 5, "twenty": 20}
    blended = sum((F.col(c) / n for c, n in lengths.items()), F.lit(0.0)) / sum(1 / n for n in lengths.values())
    return _forecasts(spark, sf_dir).where("one is not null").select("event_id", F.round(blended, 6).alias("blended"))


@query("""WITH c AS (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS incident, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT incident, row_number() OVER (ORDER BY incident) - 1 AS before FROM (SELECT DISTINCT incident FROM c)),
    h AS (SELECT c.*, before, coalesce(count(*) OVER p, 0) AS ep, coalesce(sum(n) OVER p, 0) AS total, coalesce(sum(n * n) OVER p, 0) AS squares FROM c JOIN k USING (incident) WINDOW p AS (PARTITION BY event_type ORDER BY incident ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, CASE WHEN before > 0 AND squares / before - pow(total / before, 2) > 0 THEN (n - total / before) / sqrt(squares / before - pow(total / before, 2)) ELSE 0 END AS z, 1 / sqrt(1 + ep) AS ochiai, CASE event_type WHEN 'error' THEN 1.0 WHEN 'signup' THEN 0.4 ELSE 0 END AS severity FROM h)
    SELECT incident, event_type, round(0.4 * least(1, greatest(0, z / 3)) + 0.3 * ochiai + 0.3 * severity, 6) AS score FROM z""")
def incident_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unusual each kind is in each incident (six hours) against all before: z-score of its count, how few incidents had it,
    severity. Windows hold a row for each incident and kind."""
    counted = events(spark, sf_dir).groupBy(F.floor(seconds("ts") / 21600).alias("incident"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("event_type").orderBy("incident").rowsBetween(Window.unboundedPreceding, -1)
    order = counted.select("incident").distinct().select("incident", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("incident")) - 1).alias("before"))
    n, before = F.col("n"), F.col("before")
    h = counted.join(order, "incident").select("incident", "event_type", "n", "before", F.count(F.lit(1)).over(past).alias("ep"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("total"), F.coalesce(F.sum(n * n).over(past), F.lit(0)).alias("squares"))
    mean = F.col("total") / F.nullif(before, F.lit(0))
    variance = F.col("squares") / F.nullif(before, F.lit(0)) - mean * mean
    z = F.when((before > 0) & (variance > 0), (n - mean) / F.sqrt(variance)).otherwise(0.0)
    severity = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "signup", 0.4).otherwise(0.0)
    score = 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), z / 3)) + 0.3 / F.sqrt(1 + F.col("ep")) + 0.3 * severity
    return h.select("incident", "event_type", F.round(score, 6).alias("score"))


_HOURLY = "WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS i, CAST(count(*) + 10 * (floor(epoch(ts) / 3600) % 24 > 11)::INT AS DOUBLE) AS x FROM events GROUP BY floor(epoch(ts) / 3600))"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x): events of each hour, with ten more in the afternoon, so that there is a season."""
    i = F.floor(seconds("ts") / 3600)
    return events(spark, sf_dir).groupBy(i.alias("i")).agg(F.count(F.lit(1)).alias("n")).select("i", (F.col("n") + 10 * (F.col("i") % 24 > 11).cast("int")).cast("double").alias("x"))


@query(_HOURLY + """, t AS (SELECT i, x, avg(x) OVER (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS a, avg(x) OVER (ORDER BY i ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING) AS b, count(*) OVER (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS n FROM h),
    d AS (SELECT i % 24 AS p, x - (a + b) / 2 AS y FROM t WHERE n = 25), s AS (SELECT p, avg(y) AS s FROM d GROUP BY 1) SELECT round(greatest(0, least(1, 1 - var_pop(y - s) / var_pop(y))), 6) AS strength FROM d JOIN s USING (p)""")
def seasonal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One minus the share of the detrended variance that the mean of each hour of the day leaves; the trend is a centred mean over
    a day. The window is over a row for each hour."""
    w = Window.partitionBy(F.lit(1)).orderBy("i")
    mean = (F.avg("x").over(w.rowsBetween(-12, 11)) + F.avg("x").over(w.rowsBetween(-11, 12))) / 2
    y = _hourly(spark, sf_dir).select((F.col("i") % 24).alias("p"), (F.col("x") - mean).alias("y"), F.count(F.lit(1)).over(w.rowsBetween(-12, 12)).alias("n")).where("n = 25")
    season = y.groupBy("p").agg(F.avg("y").alias("s"))
    strength = 1 - F.var_pop(F.col("y") - F.col("s")) / F.var_pop("y")
    return y.join(F.broadcast(season), "p").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength)), 6).alias("strength"))


@query(_HOURLY + """, m AS (SELECT avg(x) AS m, var_pop(x) * count(*) AS t FROM h), c AS (SELECT l.lag, sum((a.x - m) * (b.x - m)) / any_value(t) AS r FROM range(2, 73) l(lag), m, h a JOIN h b ON b.i = a.i + l.lag GROUP BY 1) SELECT CAST(arg_max(lag, r) AS INTEGER) AS period, round(max(r), 6) AS r FROM c HAVING max(r) >= 0.2""")
def seasonality_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the largest autocorrelation, if it is 0.2 at least."""
    found = series.autocorrelation(_hourly(spark, sf_dir), "i", "x", 2, 72)
    return found.agg(F.max_by("lag", "r").alias("period"), F.max("r").alias("r")).where("r >= 0.2").select("period", F.round("r", 6).alias("r"))


@query("""WITH g AS (SELECT user_id, value, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events), a AS (SELECT user_id, avg((value IS NOT NULL)::INT) AS completeness, least(1, count(*) / 60) AS sufficiency, 1 / (1 + coalesce(stddev_pop(gap) / avg(gap), 0)) AS regularity, avg(value) AS m, stddev_pop(value) AS s FROM g GROUP BY 1),
    o AS (SELECT user_id, 1 - avg((abs(value - m) > 3 * s)::INT) AS cleanliness FROM g JOIN a USING (user_id) GROUP BY 1) SELECT user_id, round(0.3 * completeness + 0.2 * regularity + 0.3 * sufficiency + 0.2 * cleanliness, 6) AS quality FROM a JOIN o USING (user_id)""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's series: complete, regular in time, long enough, free of outliers."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events(spark, sf_dir).select("user_id", "value", ((t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6).alias("gap"))
    share = lambda c: F.avg(c.cast("int"))
    whole = rows.groupBy("user_id").agg(share(F.col("value").isNotNull()).alias("complete"), F.least(F.lit(1.0), F.count(F.lit(1)) / 60).alias("enough"), (1 / (1 + F.coalesce(F.stddev_pop("gap") / F.avg("gap"), F.lit(0.0)))).alias("regular"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    clean = rows.join(whole.select("user_id", "m", "s"), "user_id").groupBy("user_id").agg((1 - share(F.abs(F.col("value") - F.col("m")) > 3 * F.col("s"))).alias("clean"))
    return whole.join(clean, "user_id").select("user_id", F.round(0.3 * F.col("complete") + 0.2 * F.col("regular") + 0.3 * F.col("enough") + 0.2 * F.col("clean"), 6).alias("quality"))
