"""Folds, ranks and windows that don't put a key into one task, against plain versions; cursors and text deltas."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered, paging, series, stats, vocabulary


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, most of them equal, and some small ones."""
    rng = random.Random(1)
    rows = [("hot", float(rng.choice([5, 5, 5, 5, rng.random() * 100])), i) for i in range(4000)] + [(f"k{i % 7}", rng.random(), i) for i in range(60)] + [("one", 3.0, 0), ("none", None, 0)]
    return spark.createDataFrame(rows, "k string, v double, i long")


def test_percentiles_of_a_hot_key(skewed):
    got = {r["k"]: r for r in ordered.linear_percentiles(skewed, ["k"], "v", {"p1": 1, "p50": 50, "p95": 95, "p100": 100}).collect()}
    want = skewed.where("v is not null").groupBy("k").agg(*(F.percentile("v", p / 100).alias(f"p{p}") for p in (1, 50, 95, 100))).collect()
    assert set(got) == {r["k"] for r in want}
    for r in want:
        assert [got[r["k"]][c] for c in ("p1", "p50", "p95", "p100")] == pytest.approx([r[c] for c in ("p1", "p50", "p95", "p100")])


@pytest.mark.parametrize("chunk", [30, 500, 10_000])
def test_windows_by_chunks(skewed, chunk):
    rows = skewed.where("v is not null")
    chunked = ordered.rolling_chunks(rows, ["k"], F.floor(F.col("i") / 100), ["i"], 20, chunk).withColumn("key", F.struct("k", "chunk"))
    got = chunked.withColumn("z", series.rolling_z("v", "key", "i", window=20)).where("real").select("k", "i", F.round("z", 6).alias("z"))
    want = rows.withColumn("z", series.rolling_z("v", "k", "i", window=20)).select("k", "i", F.round("z", 6).alias("z"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_smoothing_in_closed_form(skewed):
    got = {r["k"]: r["smoothed"] for r in ordered.weighted(skewed.where("v is not null"), ["k"], ["i"], "v", 0.3).collect()}
    for k in got:
        s = None
        for r in skewed.where((F.col("k") == k) & F.col("v").isNotNull()).orderBy("i").collect():
            s = r["v"] if s is None else 0.7 * s + 0.3 * r["v"]
        assert got[k] == pytest.approx(s)


def test_folds_are_in_order(spark, skewed):
    def step(last, row):
        return row["i"], (row["k"], row["i"], last)

    got = ordered.folded(skewed, ["k"], ["i"], lambda: None, step, "k string, i long, last long", ["i"])
    want = skewed.select("k", "i", F.lag("i").over(Window.partitionBy("k").orderBy("i")).alias("last"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordered.folded(skewed.limit(0), ["k"], ["i"], lambda: None, step, "k string, i long, last long", ["i"]).collect() == []


def test_adjusted_p_values(spark):
    rng = random.Random(2)
    p = [round(rng.random() ** 3, 3) for _ in range(300)] + [0.0, 1.0]
    got = [r["adjusted"] for r in stats.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p", 0.1).orderBy("p").collect()]
    n, least, want = len(p), 1.0, []
    for x in sorted(p, reverse=True):
        least = min(least, x * n / sum(y <= x for y in p))
        want.append(least)
    assert got == pytest.approx(want[::-1])


def test_fingerprints_ignore_order():
    a = {"and": [{"f": "x", "in": [2, 1]}, {"or": [{"f": "y", "eq": 1}, {"f": "z", "gt": 0}]}]}
    b = {"and": [{"or": [{"gt": 0, "f": "z"}, {"f": "y", "eq": 1}]}, {"in": [1, 2], "f": "x"}]}
    assert paging.fingerprint(a) == paging.fingerprint(b) != paging.fingerprint(a["and"][0])
    assert len(paging.fingerprint(a)) == 16


def test_cursors_that_are_none(spark):
    raw = ["b64:", "b64:!!", "x", "b64:eyJzIjoxfQ", None, "b64:bm90IGpzb24"]
    df = spark.createDataFrame([(x,) for x in raw], "c string")
    assert {r["e"] for r in df.select(paging.cursor_state(F.col("c"), "asc", "0").getField("error").alias("e")).collect()} == {"malformed"}
    assert {tuple(r["s"]) for r in df.select(paging.time_cursor_state(F.col("c")).alias("s")).collect()} == {(None, None)}
    longest = spark.range(1).select(paging.cursor_state(paging.cursor(F.lit(2**62), "asc", "f" * 200, F.lit(2**62)), "asc", "f" * 200).alias("s")).first()["s"]
    assert (longest["seq"], longest["error"]) == (2**62, None)


def test_text_deltas_restore(spark):
    rows = [("abc", "abc"), ("", "x"), ("x", ""), ("aXb", "aYYb"), ("aa", "aaa"), ("aaa", "aa"), ("wörter", "wärter"), ("abcabc", "abc")]
    df = spark.createDataFrame(rows, "a string, b string")
    d = vocabulary.text_delta(F.col("a"), F.col("b"))
    for r in df.select("b", d.alias("d"), vocabulary.patched(F.col("a"), d).alias("r")).collect():
        assert r["r"] == r["b"] and r["d"]["prefix"] + r["d"]["suffix"] + len(r["d"]["middle"]) == len(r["b"])


def test_posting_lists(spark):
    postings = spark.createDataFrame([(i, t) for i in range(50) for t in ("a", "b", "c") if i % {"a": 1, "b": 2, "c": 5}[t] == 0], "doc_id long, token string")
    assert sorted(r["doc_id"] for r in vocabulary.with_all(postings, ["a", "b", "c"]).collect()) == list(range(0, 50, 10))
    assert vocabulary.with_all(postings, ["a", "zz"]).collect() == []
    newer = spark.createDataFrame([(0, "z")], "doc_id long, token string")
    assert vocabulary.newest_segment([postings, newer], "doc_id").where("doc_id = 0").collect() == [(0, "z")]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 65, 70])
def test_merkle_root_in_rounds(spark, n):
    import hashlib

    from sparkloom.operators import delta

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(f"{i}=v{i * 7}") for i in range(n)]
    while len(level) > 1:
        level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    rows = spark.createDataFrame([(i, f"v{i * 7}") for i in range(n)], "k long, v string").repartition(5)
    assert delta.merkle_root(rows, "k", "v", 2).first()["root"] == level[0]
    assert delta.merkle_root(rows.limit(0), "k", "v", 2).collect() == []
