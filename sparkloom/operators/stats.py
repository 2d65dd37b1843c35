"""Multiple testing, correlation with lags, mutual information, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """df with `adjusted` (step-up p-values) and `significant`; equal p-values share the largest of their ranks.

    Tests are parted into 4096 ranges of p. Ranks and smallest raw values are found within each range and carried on over
    the ranges, which are few, so no task orders all tests.
    """
    part = F.least(F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) * 4096), F.lit(4095))
    parted = df.withColumn("_part", part)
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy(F.lit(1))  # over at most 4096 rows, here and below
    offsets = sizes.select("_part", (F.sum("_n").over(all_.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(all_).alias("_all"))
    rank = F.col("_before") + F.count(F.lit(1)).over(Window.partitionBy("_part").orderBy(p))
    ranked = parted.join(F.broadcast(offsets), "_part").withColumn("_raw", F.col(p) * F.col("_all") / rank)
    least = ranked.groupBy("_part").agg(F.min("_raw").alias("_m"))
    behind = least.select("_part", F.min("_m").over(all_.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"))
    own = F.min("_raw").over(Window.partitionBy("_part").orderBy(F.desc(p)))
    out = ranked.join(F.broadcast(behind), "_part").withColumn("adjusted", F.least(F.lit(1.0), own, F.col("_behind")))
    return out.drop("_part", "_before", "_all", "_raw", "_behind").withColumn("significant", F.col("adjusted") <= alpha)


def lagged_correlation(df: DataFrame, index: str, a: str, b: str, most: int) -> DataFrame:
    """(lag, r, n) of a[i] against b[i + lag] for each lag from -most to most."""
    other = df.select(F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), F.col(index).alias("_j"), F.col(b).alias("_b")).withColumn(index, F.col("_j") - F.col("lag"))
    return df.join(other, index).groupBy("lag").agg(F.corr(a, "_b").alias("r"), F.count(F.lit(1)).alias("n"))


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 8) -> DataFrame:
    """One row (mi, normalised): from a bins x bins histogram, normalised by the smaller entropy."""
    bounds = df.agg(*(f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1))
    cells = df.crossJoin(F.broadcast(bounds)).select(cell(a).alias("x"), cell(b).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # at most bins * bins rows from here on
    shares = cells.select(*(c for c in ("x", "y")), (F.col("n") / total).alias("p"))
    shares = shares.withColumn("px", F.sum("p").over(Window.partitionBy("x"))).withColumn("py", F.sum("p").over(Window.partitionBy("y")))
    out = shares.agg(F.sum(F.expr("p * ln(p / (px * py))")).alias("mi"), (-F.sum(F.expr("p * ln(px)"))).alias("hx"), (-F.sum(F.expr("p * ln(py)"))).alias("hy"))
    return out.select("mi", F.when(F.least("hx", "hy") > 0, F.col("mi") / F.least("hx", "hy")).otherwise(0.0).alias("normalised"))


def random_walk(edges: DataFrame, restart: DataFrame, alpha: float = 0.15, tolerance: float = 1e-6, most_rounds: int = 120, rounds_between: int = 6) -> DataFrame:
    """(node, score) of a walk along edges(src, dst, weight) against their direction, with restarts at restart(node, weight).

    Rows are normalised by the weight out of a node; what is at nodes without a way on goes to the restart nodes. That
    only scales the scores, so the rounds leave it out and the result is brought to a sum of 1. Stops when the
    scores change by less than `tolerance` in all. Lineage is cut by a checkpoint each few rounds.
    """
    total = restart.agg(F.sum("weight").alias("s"))
    start = restart.crossJoin(F.broadcast(total)).select("node", (F.col("weight") / F.col("s")).alias("base")).where("base > 0")
    out = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("out"))
    steps = edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), "weight").join(out, "node").select("node", "to", (F.col("weight") / F.col("out")).alias("p"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(start.select("node")).distinct().join(start, "node", "left").select("node", F.coalesce("base", F.lit(0.0)).alias("base")).checkpoint()
    steps = steps.checkpoint()
    score = nodes.select("node", F.col("base").alias("score"))
    for _ in range(-(-most_rounds // rounds_between)):
        new = score
        for _ in range(rounds_between):
            moved = new.join(steps, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("in"))
            new = nodes.join(moved, "node", "left").select("node", ((1 - alpha) * F.coalesce("in", F.lit(0.0)) + alpha * F.col("base")).alias("score"))
        new = new.checkpoint()
        change = new.alias("n").join(score.alias("o"), "node").agg(F.sum(F.abs(F.col("n.score") - F.col("o.score")))).first()[0] or 0.0
        score = new
        if change < tolerance:
            break
    total = score.agg(F.sum("score").alias("t"))
    return score.crossJoin(F.broadcast(total)).select("node", (F.col("score") / F.col("t")).alias("score"))


def reachable(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(src, dst, hops) for every pair joined by a path, with the least number of edges; a node doesn't reach itself
    unless by a cycle."""
    one = edges.select("src", "dst").distinct()
    found, edge_ = one.withColumn("hops", F.lit(1)).checkpoint(), one
    fresh = found
    for i in range(2, most_rounds + 2):
        new = fresh.select("src", F.col("dst").alias("via")).join(edge_.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        fresh = new.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(i)).checkpoint()
        if fresh.isEmpty():
            break
        found = found.union(fresh).checkpoint()
    return found
