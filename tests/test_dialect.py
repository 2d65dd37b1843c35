import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dialect


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(1, "ERROR", "auth", 10.0, "7"), (2, "INFO", None, None, "x"), (3, None, "auth", 5.0, "12"), (4, "ERROR", "db", 20.0, None)]
    return spark.createDataFrame(rows, "id long, level string, service string, ms double, code string")


def ids(logs, condition):
    return [r[0] for r in dialect.run(f"SELECT id FROM logs WHERE {condition} ORDER BY id", {"logs": logs}).collect()]


def test_two_truth_values(logs):
    assert ids(logs, "level != 'ERROR'") == [2]
    assert ids(logs, "NOT level = 'ERROR'") == [2, 3]
    assert ids(logs, "level IN ('ERROR') AND NOT service = 'db'") == [1]
    assert ids(logs, "ms = NULL") == [] and ids(logs, "NOT ms = NULL") == [1, 2, 3, 4]


def test_numbers_in_text(logs):
    assert ids(logs, "code > 8") == [3]
    assert ids(logs, "code = '7'") == [1]


def test_precedence(logs):
    assert ids(logs, "id = 1 OR id = 2 AND level = 'ERROR'") == [1]
    assert ids(logs, "(id = 1 OR id = 4) AND ms BETWEEN 15 AND 30") == [4]
    assert ids(logs, "service CONTAINS 'UT' OR id NOT IN (1, 2, 3)") == [1, 3, 4]
    assert ids(logs, "service LIKE 'a%'") == [1, 3] and ids(logs, "ms > -1") == [1, 3, 4]


def test_aggregates_having_and_order(logs):
    text = "SELECT service, COUNT(*) AS n, AVG(ms) FROM logs GROUP BY service HAVING COUNT(*) >= 1 AND MAX(ms) > 1 ORDER BY SUM(ms) DESC LIMIT 2"
    got = dialect.run(text, {"logs": logs})
    assert got.columns == ["service", "n", "AVG(ms)"]
    assert [tuple(r) for r in got.collect()] == [("db", 1, 20.0), ("auth", 2, 7.5)]
    empty = dialect.run("SELECT COUNT(*) AS n, SUM(ms) AS s FROM logs WHERE id > 99", {"logs": logs}).first()
    assert (empty["n"], empty["s"]) == (0, None)


def test_nulls_in_order(logs):
    assert [r[0] for r in dialect.run("SELECT id FROM logs ORDER BY ms ASC", {"logs": logs}).collect()] == [3, 1, 4, 2]
    assert [r[0] for r in dialect.run("SELECT id FROM logs ORDER BY ms DESC OFFSET 1", {"logs": logs}).collect()] == [2, 4, 1, 3][1:]


def test_distinct(logs):
    assert [r[0] for r in dialect.run("SELECT DISTINCT level FROM logs ORDER BY level", {"logs": logs}).collect()] == ["ERROR", "INFO", None]


def test_aliases_and_stars(logs):
    assert dialect.run("SELECT id AS x, level FROM logs ORDER BY x DESC LIMIT 1", {"logs": logs}).first().asDict() == {"x": 4, "level": "ERROR"}
    assert dialect.run("SELECT * FROM logs", {"logs": logs}).columns == logs.columns


@pytest.mark.parametrize(
    ("text", "where"),
    [("SELECT FROM logs", "line 1, column 8"), ("SELECT id FROM logs WHERE", "column 26"), ("SELECT id\nFROM logs WHERE id ~ 1", "line 2, column 20"), ("SELECT id FROM nowhere", "nowhere"), ("SELECT id FROM logs LIMIT 1.5", "whole number"), ("SELECT id FROM logs extra", "expected the end")],
)
def test_errors_say_where(logs, text, where):
    with pytest.raises(dialect.DialectError, match=where):
        dialect.run(text, {"logs": logs})


def test_filters_reach_the_scan(spark, small):
    plan = dialect.explain("SELECT event_id FROM events WHERE user_id IN (1, 2)", {"events": spark.read.parquet(f"{small}/events.parquet")})
    assert "PushedFilters" in plan or "In(user_id" in plan


def test_facets_keep_selected_values(spark):
    from sparkloom.operators import filters

    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "s string, t string")
    got = {(r["dimension"], r["value"]): r["n"] for r in filters.facets(df, ["s", "t"], {"t": ["z"], "s": ["a"]}).collect()}
    assert got == {("t", "x"): 1, ("t", "y"): 1, ("t", "z"): 0, ("s", "a"): 0}


def test_search_tree_rules(spark):
    from sparkloom.operators import filters

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    keep = lambda node: [r["id"] for r in df.where(filters.tree(node)).orderBy("id").collect()]
    assert keep({"all": []}) == [1, 2] and keep({"any": []}) == []
    assert keep({"field": "s", "op": "ne", "value": "a"}) == [2] and keep({"not": {"field": "s", "op": "eq", "value": "b"}}) == [1, 2]
    assert keep({"field": "s", "op": "nin", "value": ["a"]}) == [2]
    deep = {"field": "s", "op": "eq", "value": "a"}
    for _ in range(filters.MAX_DEPTH + 1):
        deep = {"not": deep}
    for bad in (deep, {"field": "s", "op": "in", "value": []}, {"field": "s", "op": "like", "value": 1}):
        with pytest.raises(ValueError):
            filters.tree(bad)


def test_keyset_pages_cover_ties_once(spark):
    from sparkloom.operators import filters

    df = spark.range(50).select("id", (F.col("id") % 3).alias("ts"))
    seen, after = [], None
    while True:
        page = [tuple(r) for r in filters.keyset_page(df, ["ts", "id"], after, 7).select("ts", "id").collect()]
        seen += page[:7]
        if len(page) <= 7:
            break
        after = page[6]
    assert len(seen) == 50 and seen == sorted(seen, reverse=True)
