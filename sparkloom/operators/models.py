"""Clusters, classifiers and outliers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kmeans(df: DataFrame, id_col: str, features: list[str], k: int, seed: int = 7) -> DataFrame:
    """(id, cluster, distance) to the nearest of k centres fitted by pyspark.ml."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(points)
    centres = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in model.clusterCenters()))
    own = F.element_at(centres, F.col("cluster") + 1)
    square = F.aggregate(F.zip_with(F.array(*(F.col(f).cast("double") for f in features)), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(points).select(id_col, "cluster", F.sqrt(square).alias("distance"))


def _components(links: DataFrame, few: int = 200_000) -> DataFrame:
    """(i, c): for every id in a link (a, b), the smallest id of its component.

    In each round an id moves to the neighbour (or itself) of the smallest hash and on to that one's; links between what ids
    have become go on, the others are done. At most `few` links are joined on the driver.
    """
    label, kind, turn = None, links.schema["a"].dataType.simpleString(), 0
    links = links.select("a", "b").distinct().checkpoint()
    while links.count() > few:
        turn += 1
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = links.union(links.select("b", "a")).groupBy("a").agg(F.min(drawn("b")).alias("m"))
        up = least.select(F.col("a").alias("i"), F.least(F.col("m"), drawn("a"))["v"].alias("c")).checkpoint()
        up = up.join(up.select(F.col("i").alias("c"), F.col("c").alias("d")), "c").select("i", F.col("d").alias("c")).checkpoint()
        moved = links.join(up.toDF("a", "p"), "a").join(up.toDF("b", "q"), "b").where("p <> q")
        links = moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().checkpoint()
        label = up if label is None else label.join(up.toDF("c", "d"), "c", "left").select("i", F.coalesce("d", "c").alias("c")).checkpoint()
    root: dict = {}

    def top(v):  # noqa: ANN001, ANN202
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    for a, b in links.collect():
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    joined = links.sparkSession.createDataFrame([(v, top(v)) for v in list(root)], f"i {kind}, c {kind}")
    if label is None:
        return joined
    label = label.join(F.broadcast(joined.toDF("c", "d")), "c", "left").select("i", F.coalesce("d", "c").alias("c"))
    return label.join(label.groupBy("c").agg(F.min("i").alias("d")), "c").select("i", F.col("d").alias("c"))


def _cell_links(p: DataFrame, cells: DataFrame, radius: float, side: float, depth: int = 12) -> DataFrame:
    """(a, b): units of full cells that have points within `radius` of each other.

    A pair of cells is decided by the boxes around their points: linked if the farthest corners are near, apart if the boxes
    are. What stays open is halved and tried again, pair by pair of quarters, until a cell's one pair is linked or none is
    left; after `depth` halvings the different points themselves are compared.
    """
    box = ("x0", "x1", "y0", "y1")
    boxes = lambda rows, *by: rows.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def between(a: Column, b: Column) -> Column:
        """Places of a box and another one, and the squares of their smallest and largest distance."""
        gap = [F.greatest(b[c + "0"] - a[c + "1"], a[c + "0"] - b[c + "1"], F.lit(0.0)) for c in "xy"]
        far = [F.greatest(b[c + "1"] - a[c + "0"], a[c + "1"] - b[c + "0"]) for c in "xy"]
        square = lambda d: d[0] * d[0] + d[1] * d[1]
        return F.struct(a["cx"].alias("ax"), a["cy"].alias("ay"), b["cx"].alias("bx"), b["cy"].alias("by"), square(gap).alias("gap"), square(far).alias("far"))

    def judged(pairs: DataFrame) -> DataFrame:
        """(a, b, sure, tried) of pairs with boxes `p` and `q` that aren't apart."""
        near = F.filter(F.flatten(F.transform("p", lambda a: F.transform("q", lambda b: between(a, b)))), lambda t: t["gap"] <= radius * radius)
        tried = pairs.select("a", "b", near.alias("tried")).where(F.size("tried") > 0)
        return tried.withColumn("sure", F.exists("tried", lambda t: t["far"] <= radius * radius)).select("a", "b", "sure", F.when(~F.col("sure"), F.col("tried")).alias("tried")).checkpoint()

    def held(side_: str, frame: DataFrame) -> DataFrame:
        """The quarters of each place as one row."""
        return frame.groupBy((F.shiftright("cx", 1)).alias(f"{side_}x"), (F.shiftright("cy", 1)).alias(f"{side_}y")).agg(F.collect_list(F.struct("cx", "cy", *box)).alias("p" if side_ == "a" else "q"))

    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)))
    one = F.array(F.struct("cx", "cy", *box))
    others = cells.select(F.col("unit").alias("b"), one.alias("q"), "cx", "cy", F.explode(steps).alias("s")).select("b", "q", (F.col("cx") - F.col("s.dx")).alias("cx"), (F.col("cy") - F.col("s.dy")).alias("cy"))
    found = judged(cells.select(F.col("unit").alias("a"), one.alias("p"), "cx", "cy").join(others, ["cx", "cy"]))
    spots, links = p.select("x", "y"), []
    for level in range(depth + 1):
        sure = found.where("sure").select("a", "b").distinct()
        links.append(sure)
        left = found.where("NOT sure").join(sure, ["a", "b"], "left_anti").select("a", "b", F.explode("tried").alias("t")).select("a", "b", "t.ax", "t.ay", "t.bx", "t.by").checkpoint()
        if not left.limit(1).count():
            break
        at = lambda k: ((F.floor(F.col("x") / side * 2.0**k)).alias("cx"), (F.floor(F.col("y") / side * 2.0**k)).alias("cy"))
        wanted = left.select(F.col("ax").alias("cx"), F.col("ay").alias("cy")).union(left.select("bx", "by")).distinct()
        spots = spots.select("x", "y", *at(level)).join(wanted, ["cx", "cy"], "left_semi").select("x", "y").distinct().checkpoint()
        if level == depth:
            here = spots.select("x", "y", *at(level))
            met = left.join(here.toDF("x", "y", "ax", "ay"), ["ax", "ay"]).join(here.toDF("x2", "y2", "bx", "by"), ["bx", "by"])
            links.append(met.where(_near(radius)).select("a", "b").distinct())
            break
        parts = boxes(spots.select("x", "y", *at(level + 1)), "cx", "cy")
        found = judged(left.join(held("a", parts), ["ax", "ay"]).join(held("b", parts), ["bx", "by"]))
    return reduce(DataFrame.union, links)


def _near(radius: float) -> Column:
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    return dx * dx + dy * dy <= radius * radius


def dbscan(df: DataFrame, id_col: str, x: str, y: str, radius: float, least: int) -> DataFrame:
    """(id, cluster) of points in the plane: cluster is the smallest id of core points joined by steps of at most `radius`,
    null for noise; a border point goes to its smallest cluster. Points without finite places are noise; places of 10^15 radii
    or more are an error.

    Points lie in cells so small that all in a cell are near each other. A cell of `least` points is full: these are core
    points of one cluster, so the cell counts as one. Points of other cells, fewer than `least` in each, are compared with all
    points of the 25 cells around; full cells with each other by boxes. So what is compared grows with the number of points,
    however dense they lie, and what is kept with the number of cells and of points outside of full ones.
    """
    side, limit = radius / 1.5, 2.0**50
    cell = lambda c: F.when(F.abs(F.col(c) / side) < limit, F.floor(F.col(c) / side)).otherwise(F.raise_error(F.lit(f"{c} is too far out")).cast("long"))
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    rows = df.select(F.col(id_col).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = rows.where(finite).select("i", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    cells = p.groupBy("cx", "cy").agg(F.min("i").alias("unit"), F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cells = cells.where((F.col("n") >= least) & (wide * wide + high * high <= radius * radius)).drop("n").checkpoint()

    placed = p.join(cells.select("cx", "cy", "unit"), ["cx", "cy"], "left")
    step = F.sequence(F.lit(-2), F.lit(2))
    around = placed.where("unit IS NULL").select(F.col("i").alias("s"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy"))
    around = around.select("s", "x2", "y2", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    met = placed.join(around, ["cx", "cy"]).where(_near(radius)).groupBy("s", F.coalesce("unit", "i").alias("u"), F.col("unit").isNotNull().alias("full")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    core = met.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("s").checkpoint()
    ours = met.join(core, "s")
    links = ours.where("full").select(F.col("s").alias("a"), F.col("u").alias("b")).union(ours.where("NOT full AND s < u").join(core.toDF("u"), "u").select("s", "u"))
    named = _components(links.union(_cell_links(p, cells, radius, side)))
    names = cells.select(F.col("unit").alias("u")).union(core).join(named.toDF("u", "c"), "u", "left").select("u", F.coalesce("c", "u").alias("c")).checkpoint()

    reached = met.join(names, "u").groupBy(F.col("s").alias("i")).agg(F.min("c").alias("c"))
    full = cells.join(names.toDF("unit", "own"), "unit").select("cx", "cy", "own")
    clusters = p.select("i", "cx", "cy").join(full, ["cx", "cy"], "left").join(reached, "i", "left").select("i", F.coalesce("own", "c").alias("cluster"))
    return clusters.union(rows.where(~finite).select("i", F.lit(None).cast(clusters.schema["cluster"].dataType))).withColumnRenamed("i", id_col)


def text_classifier(train: DataFrame, rows: DataFrame, text_col: str, label_col: str, id_col: str, features: int = 1 << 14) -> DataFrame:
    """(id, prediction, probability): hashed term counts, inverse document frequencies, and the mean of the probabilities of
    a naive Bayes and a logistic model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    prepare = Pipeline(stages=[RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[^a-zà-ÿ]+", minTokenLength=2), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x")]).fit(train)
    fitted = prepare.transform(train).select("_x", F.col(label_col).cast("double").alias("_y"))
    bayes = NaiveBayes(featuresCol="_x", labelCol="_y", probabilityCol="_p1", rawPredictionCol="_r1", predictionCol="_d1").fit(fitted)
    logistic = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.05, probabilityCol="_p2", rawPredictionCol="_r2", predictionCol="_d2").fit(fitted)
    scored = logistic.transform(bayes.transform(prepare.transform(rows)))
    p = (vector_to_array("_p1")[1] + vector_to_array("_p2")[1]) / 2
    return scored.select(id_col, (p >= 0.5).cast("int").alias("prediction"), p.alias("probability"))


def isolation_scores(df: DataFrame, id_col: str, features: list[str], trees: int = 64, sample: int = 256, seed: int = 11) -> DataFrame:
    """(id, score) of an isolation forest: near 1 for outliers. Trees are grown on the driver from a bounded sample (the first
    rows by a hash of the id, trees * sample at most) and sent to the executors as arrays."""
    drawn = df.select(F.xxhash64(id_col, F.lit(seed)).alias("h"), *features).na.drop().orderBy("h").limit(min(trees * sample, 20_000)).toPandas()[features].to_numpy(float)
    rng, forest, depth = np.random.default_rng(seed), [], int(np.ceil(np.log2(max(sample, 2))))

    def mean_depth(n: float) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x: np.ndarray, level: int) -> tuple:
        spread = x.max(0) - x.min(0) if len(x) else np.zeros(len(features))
        if level == depth or len(x) < 2 or not spread.any():
            return (level + mean_depth(len(x)),)
        f = int(rng.choice(np.flatnonzero(spread)))
        at = rng.uniform(x[:, f].min(), x[:, f].max())
        return (f, at, grow(x[x[:, f] < at], level + 1), grow(x[x[:, f] >= at], level + 1))

    for _ in range(trees if len(drawn) else 0):
        forest.append(grow(drawn[rng.choice(len(drawn), min(sample, len(drawn)), replace=False)], 0))
    normal = mean_depth(min(sample, len(drawn))) or 1.0

    def lengths(tree: tuple, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if len(tree) == 1:
            out[rows] += tree[0]
        elif len(rows):
            left = x[rows, tree[0]] < tree[1]
            lengths(tree[2], x, rows[left], out)
            lengths(tree[3], x, rows[~left], out)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
            total = np.zeros(len(x))
            for tree in forest:
                lengths(tree, x, np.arange(len(x)), total)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(2.0 ** (-total / max(len(forest), 1) / normal))], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, *features).na.drop().mapInArrow(score, f"`{id_col}` {kind}, score double")


def calibrated(df: DataFrame, score: str, label: str) -> DataFrame:
    """df with `calibrated`, the isotonic fit of label on score."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    x = VectorAssembler(inputCols=[score], outputCol="_x").transform(df)
    return IsotonicRegression(featuresCol="_x", labelCol=label, predictionCol="calibrated").fit(x).transform(x).drop("_x")
