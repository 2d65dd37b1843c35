"""Conflicts, spans, schemas, reports and models against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators import models, resolve, schemas
from sparkloom.sources import reports


def test_vector_clocks(spark):
    rows = [("k", {"a": 2, "b": 1}, 5.0, "newer"), ("k", {"a": 1, "b": 1}, 9.0, "older"), ("m", {"a": 1}, 1.0, "x"), ("m", {"b": 1}, 2.0, "y"), ("e", {"a": 1}, 1.0, "p"), ("e", {"a": 1}, 1.0, "p")]
    df = spark.createDataFrame(rows, "k string, clock map<string,int>, at double, v string")
    got = {r["k"]: r["v"] for r in resolve.resolved(df, "k", "clock", "at", "v").collect()}
    assert got == {"k": "newer", "m": "y", "e": "p"}


def test_replica_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "w"), (3, None)], "k long, v string")
    assert sorted(map(tuple, resolve.replica_diff(a, b, "k", "v").collect())) == [(2, "y", "z"), (4, None, "w")]


def test_ttl_and_spans(spark):
    row = spark.range(1).select(F.array(*(F.lit(float(t)) for t in (0, 1, 5, 9, 10, 16))).alias("t"), F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 5), (3, 9), (5, 7), (6, 8), (8, 9)))).alias("s"))
    got = row.select(resolve.first_within_ttl(F.col("t"), 5.0).alias("t"), resolve.without_overlaps(F.col("s")).alias("s")).first()
    assert got["t"] == [0.0, 5.0, 10.0, 16.0] and [tuple(x) for x in got["s"]] == [(0, 5), (5, 7), (8, 9)]
    none = spark.range(1).select(resolve.first_within_ttl(F.array().cast("array<double>"), 5.0).alias("t"), resolve.without_overlaps(F.array().cast("array<struct<start:int,end:int>>")).alias("s")).first()
    assert none["t"] == [] and none["s"] == []


def test_schema_evolution(spark):
    v = {"1": StructType.fromDDL("a int, b string"), "2": StructType.fromDDL("a long, b string, c string"), "3": StructType.fromDDL("a long NOT NULL, d map<string,string> NOT NULL")}
    assert schemas.problems(v["1"], v["2"]) == [] and schemas.problems(v["1"], v["3"]) == ["d is required and missing"]
    assert schemas.problems(v["2"], v["1"]) == ["a was bigint and is int"]
    assert schemas.matrix(v)["1", "2"] and not schemas.matrix(v)["2", "3"]
    assert schemas.backward_report(v["2"], v["3"]) == {"removed": ["b", "c"], "newly_required": ["d"]}
    row = schemas.as_version(spark.createDataFrame([(1, "x")], v["1"]), v["2"]).first()
    assert row.asDict() == {"a": 1, "b": "x", "c": None}


def test_reports_and_ranges(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    for kind in reports.EXPORTERS:
        paths = reports.export({"summary": df, "events": df.limit(0)}, f"{tmp_path}/{kind}", kind)
        assert len(paths) == 2
    with pytest.raises(ValueError):
        reports.export({}, str(tmp_path), "pdf")
    assert reports.line_ranges(10, 3) == [(0, 3), (3, 6), (6, 10)] and reports.line_ranges(2, 4) == [(0, 0), (0, 0), (0, 0), (0, 2)]
    (tmp_path / "x.log").write_text("one\ntwo\n")
    assert [r["line"] for r in reports.lines(spark, [f"{tmp_path}/*.log"]).collect()] == ["one", "two"]


def test_following_a_folder(spark, tmp_path):
    from sparkloom.streaming import engine

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    assert sorted(r["line"] for r in engine.appended(reports.follow(spark, f"{tmp_path}/in")).collect()) == ["one", "two"]


def test_dbscan_against_brute_force(spark):
    rng = random.Random(5)
    points = [(i, rng.gauss(10 * (i % 3), 1.2), rng.gauss(0, 1.2)) for i in range(150)] + [(150 + i, rng.uniform(-30, 60), rng.uniform(-30, 30)) for i in range(20)]
    near = {i: [j for j, u, w in points if (x - u) ** 2 + (y - w) ** 2 <= 1] for i, x, y in points}
    core = {i for i, n in near.items() if len(n) >= 4}
    want = {}
    for i in sorted(core):
        if i not in want:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in want:
                    want[k] = i
                    todo += [j for j in near[k] if j in core]
    for i in near:
        if i not in core and any(j in core for j in near[i]):
            want[i] = min(want[j] for j in near[i] if j in core)
    got = {r["id"]: r["cluster"] for r in models.dbscan(spark.createDataFrame(points, "id long, x double, y double"), "id", "x", "y", 1.0, 4).collect()}
    assert got == {i: want.get(i) for i in near}


def _clusters(points: list, radius: float, least: int) -> dict:
    near = {i: [j for j, u, w in points if (x - u) ** 2 + (y - w) ** 2 <= radius * radius] for i, x, y in points}
    core, want = {i for i, n in near.items() if len(n) >= least}, {}
    for i in sorted(core):
        todo = [] if i in want else [i]
        while todo:
            k = todo.pop()
            if k not in want:
                want[k] = i
                todo += [j for j in near[k] if j in core]
    return {i: want[i] if i in core else min((want[j] for j in near[i] if j in core), default=None) for i in near}


def test_dbscan_of_dense_points_keeps_little(spark, monkeypatch):
    """Full cells with narrow gaps, exact distances and copies: equal to brute force, and no table of all neighbours."""
    rng = random.Random(8)
    rings = [(r * math.cos(t), r * math.sin(t)) for r, n in ((2, 150), (3.02, 200), (4.0, 250)) for t in (2 * math.pi * k / n for k in range(n))]
    lines = [(x, 9 + k / 40) for k in range(80) for x in (0.0, 1.0, 2.0 + 1e-9)] + [(12 + k / 9, 0.5 * (k % 2)) for k in range(60)]
    sparse = [(rng.uniform(-12, 14), rng.uniform(-8, 12)) for _ in range(150)]
    places = rings + lines + [(20.0, 20.0)] * 900 + [(21.0, 20.0)] * 3 + [(21.5, 20.5), (-7.0, 3.0), (-6.0, 3.0)] + sparse
    rng.shuffle(places)
    points = [(i, x, y) for i, (x, y) in enumerate(places)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    kept, before = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a: kept.append(out := before(self, *a)) or out)
    got = {r["id"]: r["cluster"] for r in models.dbscan(df, "id", "x", "y", 1.0, 4).collect()}
    assert got == _clusters(points, 1.0, 4)
    assert max(k.count() for k in kept) < 10 * len(points)  # of 900 copies alone there are 810,000 pairs


def test_dbscan_of_odd_points(spark):
    odd = [(1, None, 0.0), (2, float("nan"), 0.0), (3, float("inf"), 0.0), (4, float("inf"), 0.0), (5, 0.0, None)]
    rows = odd + [(i, 5e14 + i % 3, -0.0) for i in range(10, 16)] + [(i, 1e5, 1e5) for i in range(20, 23)]
    got = {r["id"]: r["cluster"] for r in models.dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 1.0, 4).collect()}
    assert got == {i: 10 if 10 <= i < 16 else None for i, _, _ in rows}
    assert models.dbscan(spark.createDataFrame(odd, "id long, x double, y double").limit(0), "id", "x", "y", 1.0, 4).collect() == []


def test_components_in_rounds(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 120)] + [(200, 200 + i) for i in range(1, 80)] + [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(90)]
    root = {i: i for e in links for i in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    for few in (0, 20, 1000):
        assert {r["i"]: r["c"] for r in models._components(df, few).collect()} == root


def test_outliers_have_high_scores(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(500)] + [(500, 9.0, 9.0), (501, -9.0, 8.0)]
    got = models.isolation_scores(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"]).orderBy(F.desc("score")).limit(2).collect()
    assert {r["id"] for r in got} == {500, 501}


def test_calibration_is_monotone(spark):
    rows = [(i / 100, float(i % 10 < i // 10)) for i in range(100)]
    got = [r["calibrated"] for r in models.calibrated(spark.createDataFrame(rows, "s double, y double"), "s", "y").orderBy("s").collect()]
    assert got == sorted(got)
