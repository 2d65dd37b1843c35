"""Operators without SQL, against plain Python."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.operators import delta, joins, layout, mapreduce, search, series, sessions, sketches, stats
from sparkloom.sources import files, lines
from sparkloom.streaming import engine, windows


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.randrange(3), rng.uniform(0, 500)) for i in range(60)]
    right = [(100 + i, rng.randrange(3), float(rng.randrange(500))) for i in range(80)]
    schema = "id long, k long, t double"
    got = {r["id"]: r["id_near"] for r in joins.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "t", "id", "id", "k", 20.0).collect()}
    want = {}
    for i, k, t in left:
        near = min(((abs(u - t), u < t, j) for j, m, u in right if m == k and abs(u - t) <= 20), default=None)
        if near:
            want[i] = near[2]
    assert got == want


def test_as_of_takes_equal_times(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, 9.0)], "k long, t double")
    right = spark.createDataFrame([(1, 5.0, "b"), (1, 2.0, "a"), (2, 10.0, "c")], "k long, t double, v string")
    assert sorted((r["k"], r["t"], r["v_as_of"]) for r in joins.as_of(left, right, "k", "t", "v").collect()) == [(1, 1.0, None), (1, 5.0, "b"), (2, 9.0, None)]


def test_session_rules():
    s = sessions.SessionState(100, 250, ("logout",), 50, 0.7)
    for t, k in ((0, "a"), (90, "a"), (180, "a"), (270, "a"), (300, "logout"), (305, "a"), (900, "b")):
        s.add(t, k)
    s.close()
    assert [(x["start"], x["end"], x["merged"]) for x in s.done] == [(0, 180, False), (270, 305, True), (900, 900, False)]
    m = sessions.SessionState(10, 1000, (), 30, 0.7)
    for t in (0, 5, 20, 25):
        m.add(t, "a")
    m.close()
    assert [(x["start"], x["end"], x["merged"]) for x in m.done] == [(0, 25, True)]


def test_batch_and_stream_sessions_agree(spark, small):
    from sparkloom.plans import registry

    batch = {(r["user_id"], r["session"]): (round(r["start"], 3), r["n"], r["kinds"]) for r in registry.queries()["hybrid_sessions"](spark, small).collect()}
    stream = {(r["user_id"], r["session"]): (round(r["start"], 3), r["n"], r["kinds"]) for r in registry.queries()["stream_hybrid_sessions"](spark, small).collect()}
    assert stream and all(batch[k] == v for k, v in stream.items())
    assert len(batch) - len(stream) <= 2 * len({u for u, _ in batch})


def test_reachability_and_walk(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    got = {(r["src"], r["dst"]): r["hops"] for r in stats.reachable(edges).collect()}
    assert got["a", "d"] == 3 and got["a", "a"] == 3 and ("d", "a") not in got and len(got) == 12
    walk = {r["node"]: r["score"] for r in stats.random_walk(edges, spark.createDataFrame([("d", 1.0)], "node string, weight double")).collect()}
    score = {n: float(n == "d") for n in "abcd"}
    back = {"b": {"a": 1.0}, "c": {"b": 1.0}, "a": {"c": 1.0}, "d": {"c": 1.0}}
    for _ in range(300):
        new = {n: 0.15 * (n == "d") for n in "abcd"}
        for n, s in score.items():
            for m, p in back.get(n, {"d": 1.0}).items():
                new[m] += 0.85 * s * p
        score = new
    assert all(abs(walk[n] - score[n]) < 1e-4 for n in "abcd")


def test_hash_chain_finds_the_first_break(spark):
    rows = spark.createDataFrame([(k, i, f"body{k}{i}") for k in (1, 2) for i in range(5)], "k long, i long, body string")
    chain = delta.hash_chain(rows, "k", "i", "body")
    assert delta.first_break(chain, "k", "i", "body").count() == 0
    broken = chain.withColumn("body", F.when((F.col("k") == 2) & (F.col("i") == 3), "other").otherwise(F.col("body")))
    assert [tuple(r) for r in delta.first_break(broken, "k", "i", "body").collect()] == [(2, 3)]


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_merkle_root(spark, n):
    level = [hashlib.sha256(f"k{i}=v{i}".encode()).hexdigest() for i in range(n)]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
    rows = spark.createDataFrame([(f"k{i}", f"v{i}") for i in reversed(range(n))], "k string, v string")
    assert delta.merkle_root(rows, "k", "v").first()["root"] == level[0]


def test_deltas(spark):
    row = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    got = row.select(delta.changed(F.col("x"), F.col("y")).alias("c"), delta.removed(F.col("x"), F.col("y")).alias("r"), delta.applied(F.col("x"), delta.changed(F.col("x"), F.col("y")), delta.removed(F.col("x"), F.col("y"))).alias("back")).first()
    assert got["c"] == {"b": "3", "c": "4"} and got["r"] == ["a"] and got["back"] == {"b": "3", "c": "4"}


def test_ring_and_md5(spark):
    nodes = ["n1", "n2", "n3"]
    rows = spark.createDataFrame([(f"key{i}",) for i in range(50)], "k string").select("k", layout.ring_node(F.col("k"), nodes).alias("node"), scoring.md5_mod(F.col("k"), 7).alias("m")).collect()
    assert all(r["node"] == layout.ring_node_of(r["k"], nodes) for r in rows) and {r["node"] for r in rows} == set(nodes)
    assert all(r["m"] == int(hashlib.md5(r["k"].encode()).hexdigest(), 16) % 7 for r in rows)


def test_luhn_masks_and_tokens(spark):
    row = spark.createDataFrame([("4111111111111111", "4111111111111112", "203.0.113.9", "The cat, a CAT and the dog 42!")], "a string, b string, ip string, t string")
    got = row.select(scoring.luhn(F.col("a")), scoring.luhn(F.col("b")), text.masked_ip(F.col("ip")), text.tokens(F.col("t")), text.partly_masked(F.col("a")), text.template(F.lit("GET https://x.y/z from 10.0.0.1 took 12.5 ms   at 2024-01-02T03:04:05Z"))).first()
    assert list(got) == [True, False, "203.0.113.0", ["cat", "dog", "42"], "************1111", "GET <URL> from <IP> took <NUM> ms at <TIME>"]


def test_line_formats(spark):
    rows = [
        '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326',
        '1.2.3.4 - - [10/Oct/2000:13:55:36 +0000] "POST /b HTTP/1.1" 503 - "http://r" "agent"',
        "<34>Oct 11 22:14:15 mymachine su[230]: 'su root' failed",
        '<165>1 2003-10-11T22:14:15.003Z host app 123 ID47 [ex@1 iut="3" src="App"] message',
        '{"timestamp": "2024-01-01", "severity": "warn", "message": "hi", "status": "404"}',
        "Jan 05 10:11:12 box sshd[99]: error: bad key",
        "free text",
        None,
    ]
    got = [r["r"] for r in spark.createDataFrame([(r,) for r in rows], "line string").select(lines.detect(F.col("line")).alias("r")).collect()]
    assert [r["format"] for r in got] == ["common", "combined", "rfc3164", "rfc5424", "json", "journal", "unknown", "unknown"]
    assert (got[0]["ts"], got[0]["bytes"], got[0]["level"], got[0]["app"]) == ("2000-10-10T20:55:36", 2326, "INFO", "frank")
    assert (got[1]["bytes"], got[1]["level"]) == (None, "ERROR") and got[2]["level"] == "CRITICAL" and got[3]["level"] == "NOTICE"
    assert (got[4]["level"], got[4]["status"], got[4]["message"]) == ("WARN", 404, "hi") and got[5]["level"] == "ERROR"
    assert spark.range(1).select(lines.structured_data(F.lit(rows[3]))).first()[0] == {"iut": "3", "src": "App"}


def test_times(spark):
    rows = [("1700000000",), ("1700000000000",), ("10/Oct/2000:13:55:36 -0700",), ("2024-01-02T03:04:05Z",), ("nonsense",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(F.unix_seconds(lines.parse_time(F.col("v")))).collect()]
    assert got == [1700000000, 1700000000, 971211336, 1704164645, None, None]


def test_sketches(spark):
    rows = spark.createDataFrame([(f"k{i % 37}",) for i in range(1000)], "k string")
    small = {r["k"]: r["estimate"] for r in sketches.frequencies(rows, "k", 3, 16).collect()}
    assert all(small[f"k{i}"] >= 1000 // 37 for i in range(37))
    bits, hashes = sketches.bloom_bits(37, 0.01)
    words = sketches.bloom_filter(rows, "k", bits, hashes)
    asked = spark.createDataFrame([(f"k{i}",) for i in range(2000)], "k string")
    found = {r["k"] for r in sketches.maybe_members(asked, "k", words, bits, hashes).collect()}
    assert {f"k{i}" for i in range(37)} <= found and len(found) < 37 + 100


def test_map_reduce_registries(spark):
    @mapreduce.python_map("letters")
    def letters(row):
        for c in row["w"]:
            yield c, 1.0

    mapreduce.post_process("large")(lambda df: df.where("v > 1"))
    df = spark.createDataFrame([("abca",), ("b",), ("",)], "w string")
    assert {r["k"]: r["v"] for r in mapreduce.run(df, "letters", "sum", "large").collect()} == {"a": 2.0, "b": 2.0}
    assert "letters" in mapreduce.analyzers()["map"] and {"sum", "count", "collect"} <= set(mapreduce.analyzers()["reduce"])


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, 9.0, None)], "id long, ts double, s string")
    old, recent = files.seal(df, "ts", 6.0)
    assert [r["id"] for r in old.collect()] == [1] and sorted(r["id"] for r in recent.collect()) == [2, 3]
    files.write(old, f"{tmp_path}/a", "parquet")
    files.write(recent.drop("s"), f"{tmp_path}/b", "json")
    both = files.read_mixed(spark, [(f"{tmp_path}/a", "parquet"), (f"{tmp_path}/b", "json")], ["id", "s", "none"])
    assert sorted(map(tuple, both.collect()), key=lambda r: r[0]) == [(1, "a", None), (2, None, None), (3, None, None)]
    assert files.choose_format(0.1, 0.1) == "parquet" and files.choose_format(0.9, 0.9) == "json"


def test_empty_streams_and_histograms(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    stream = windows.timed(engine.read_stream(spark, str(tmp_path), "events"))
    assert engine.complete(windows.tumbling(stream, "1 hour")).collect() == []
    assert series.histogram(spark.createDataFrame([], "t double"), F.col("t"), 10).collect() == []


def test_alert_cooldown():
    a = windows.Alerts(5, 10, 60)
    assert [a.check("k", v, t) for v, t in ((12, 0), (12, 30), (6, 31), (12, 61), (1, 70))] == ["critical", None, "warning", "critical", None]


def test_canonical_rows(spark):
    got = spark.range(1).select(F.to_json(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")))).first()[0]
    assert got == json.dumps({"a": 1, "b": "x"}, separators=(",", ":"))


def test_sessions_of_idle_users_come_out(spark, tmp_path):
    """The watermark that another user's rows move closes the last session of one who is idle."""
    import time

    from sparkloom.streaming import stateful

    schema = "user_id long, event_id long, ts timestamp, event_type string"
    for i, rows in enumerate(([(1, 1, "2024-01-01 00:00:00", "view"), (1, 2, "2024-01-01 00:05:00", "click")], [(2, 3, "2024-01-02 00:00:00", "view")], [(2, 4, "2024-01-03 00:00:00", "view")])):
        spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows")).withWatermark("ts", "1 hour")
    got = stateful.hybrid_sessions(stream, timeout=1800.0, longest=14_400.0, closing=("purchase",), merge_within=300.0, similar=0.7).collect()
    assert sorted((r["user_id"], r["session"], r["n"], r["kinds"]) for r in got) == [(1, 1, 2, "click=1,view=1")]


def test_tf_idf_of_shared_ids_and_rare_tokens(spark):
    """Rows of one id, or of none, are one document; the same with nothing, something or everything broadcast; and no
    shuffle of all postings if ids differ."""
    rows = [(1, "Beta beta alpha the"), (1, "alpha gamma"), (2, "alpha delta"), (3, "the of"), (4, None), (5, ""), (None, "alpha zeta"), (None, "zeta"), (6, "x9 x9 " + "q" * 500), (7, "alpha beta x9")]
    want: dict = {}
    for i, text in rows:
        for w in re.findall("[a-z0-9]{2,}", (text or "").lower()):
            if w not in ("the", "of"):
                want.setdefault(i, Counter())[w] += 1
    df = Counter(w for c in want.values() for w in c)
    want = {(i, w): c[w] / c.total() * math.log(len(want) / df[w]) for i, c in want.items() if i is not None for w in c}
    docs = spark.createDataFrame(rows, "id long, text string")
    for most in (0, 5, 20, 400_000):
        got = search.tf_idf(docs, "id", "text", most).collect()
        assert len(got) == len(want) and {(r["doc_id"], r["token"]): r["score"] for r in got} == pytest.approx(want)
    assert search.tf_idf(docs.where("id IN (3, 4, 5)"), "id", "text").collect() == []
    plan = search.tf_idf(docs.where("id IN (2, 6, 7)"), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
