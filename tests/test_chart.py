import pytest

from lodeflow.operators.chart import chart, group_sum, numeric_columns


def test_totals(spark):
    rows = [("p", "1"), ("q", None), ("p", "2"), ("r", "abc"), (None, "5"), ("s", "0x1")]
    out = chart(spark.createDataFrame(rows, "x string, y string"), "x", "y")
    assert [tuple(r) for r in out.collect()] == [("null", 5.0), ("p", 3.0), ("s", 1.0), ("q", 0.0)]


def test_booleans_count_one(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "x string, y boolean")
    assert dict(map(tuple, group_sum(df, "x", "y").collect())) == {"a": 2.0, "b": 0.0}


def test_top_twenty_and_plan(spark):
    df = spark.createDataFrame([(i, i) for i in range(25)], "x int, y int")
    out = group_sum(df, "x", "y")
    assert [r["label"] for r in out.collect()] == [str(i) for i in range(24, 4, -1)]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()


def test_ties_by_first_seen(spark):
    df = spark.createDataFrame([("b", 1, 0), ("a", 1, 1)], "x string, y int, o int")
    assert [r["label"] for r in group_sum(df, "x", "y", order="o").collect()] == ["b", "a"]


def test_nothing_usable(spark):
    df = spark.createDataFrame([("a", "x")], "x string, y string")
    with pytest.raises(ValueError):
        chart(df, "x", "y")


def test_measures(spark):
    df = spark.createDataFrame([("a", 1, None)], "s string, n int, e double")
    assert numeric_columns(df) == ["n"]
