import pytest
from pyspark.sql import functions as F

from lodeflow.operators.merge import merge, output_names, preview, shared_column

INNER = {(1, "a1", "b1", "w1"), (1, "a2", "b1", "w1"), (None, "a4", "b3", "w3")}


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, "a1"), (1, "a2"), (2, "a3"), (None, "a4")], "k int, v string")
    b = spark.createDataFrame([(1, "b1", "w1"), (3, "b2", "w2"), (None, "b3", "w3")], "k int, v string, w string")
    return a, b


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(
    ("how", "flag", "more"),
    [
        ("inner", "own", set()),
        ("left", "own", {(2, "a3", None, None)}),
        ("right", "own", {(3, None, "b2", "w2")}),
        ("right", "left_slot", {(3, "b2", None, "w2")}),
        ("outer", "own", {(2, "a3", None, None), (3, None, "b2", "w2")}),
    ],
)
def test_joins(sides, how, flag, more):
    out = merge(*sides, how, right_collision=flag)
    assert out.columns == ["k", "v", "v_b", "w"]
    assert rows(out) == INNER | more and out.count() == len(INNER | more)


def test_counts_add_up(sides):
    n = {how: merge(*sides, how).count() for how in ("inner", "left", "right", "outer")}
    assert n["outer"] == n["left"] + n["right"] - n["inner"]


def test_kinds_never_mix(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k bigint, v string")
    b = spark.createDataFrame([("1", "y"), (None, "m")], "k string, w string")
    assert rows(merge(a, b, "inner")) == {(None, "n", "m")}
    assert merge(a, b, "outer").count() == 3
    c = spark.createDataFrame([(1.0, "z")], "k double, u string")
    assert rows(merge(a, c, "inner")) == {(1.0, "x", "z")}


def test_names(spark):
    assert output_names(["k", "x", "x_b"], ["k", "x"], "k") == ["k", "x", "x_b", "x_b_b"]
    a, b = (spark.createDataFrame([(1,)], f"{c} int") for c in ("K", "k"))
    with pytest.raises(ValueError):
        shared_column(a, b)


def test_plans(sides):
    for how in ("inner", "left", "right", "outer"):
        plan = merge(*sides, how)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_computed_keys_are_columns(spark):
    """Keys that no decimal type holds together are computed once a row: neither sorts nor the join hold their expressions."""
    big = "123456789012345678901234567890"
    a = spark.createDataFrame([(big,), ("-7",), ("0",), ("100",), (None,)], "t string").select(F.col("t").cast("decimal(38,0)").alias("k"), F.col("t").alias("x"))
    b = spark.createDataFrame([("-7.000",), ("0.0",), ("100.000000000000000001",), ("100",), ("0.000000000000000001",), (None,)], "t string").select(F.col("t").cast("decimal(38,18)").alias("k"), F.col("t").alias("y"))
    out = merge(a, b, "outer")
    got = {tuple(r) for r in out.collect()}
    assert got == {(big, big, None), ("-7", "-7", "-7.000"), ("0", "0", "0.0"), ("100", "100", "100"), (None, None, None), ("100.000000000000000001", None, "100.000000000000000001"), ("0.000000000000000001", None, "0.000000000000000001")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge(a, b, "outer")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "regexp" not in join and "trim" not in join and "cast" not in join, join


def test_preview(spark):
    df = spark.createDataFrame([(i, None if i == 3 else 1.0 * i) for i in range(20)], "i int, x double")
    out = preview(df, ["i"]).collect()
    assert len(out) == 15 and out[3]["x"] == "" and out[4]["x"] == "4"


def test_same_dataset_is_refused(spark):
    from lodeflow.operators.merge import merge_datasets

    with pytest.raises(ValueError):
        merge_datasets(spark, "r", ("Bronze", "x"), ("Bronze", "x"))
