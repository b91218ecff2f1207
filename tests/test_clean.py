import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeflow.operators.clean import clean, dedupe


def column(spark, cells, name="c"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, {name} string")


def fixed(spark, cells, **options):
    out = clean(column(spark, cells), ["fix_types"], **options)
    return [r["c"] for r in out.orderBy("i").collect()], dict(out.dtypes)["c"]


def test_numeric_vote(spark):
    values, kind = fixed(spark, [*"123456789", "abc"])
    assert kind == "double" and values[:9] == [float(i) for i in range(1, 10)] and math.isnan(values[9])
    assert fixed(spark, ["1", "2", "3", "4", "abc"]) == (["1", "2", "3", "4", "abc"], "string")
    assert fixed(spark, ["", None]) == (["", None], "string")
    assert fixed(spark, ["1", "2", "3", "4", "5", None])[0] == [1, 2, 3, 4, 5, None]
    assert fixed(spark, [" ", "1", "2", "3", "4", "5"])[0] == [0, 1, 2, 3, 4, 5]


def test_date_vote(spark):
    assert fixed(spark, ["2024-01-05"] * 9 + ["abc"])[0] == ["2024-01-05"] * 9 + ["abc"]
    assert fixed(spark, ["1/5/2024"] * 6 + [None])[0] == ["2024-01-05"] * 6 + [None]
    assert fixed(spark, ["1/5/2024"] * 6 + [None], null_dates="epoch")[0][-1] == "1970-01-01"


def test_dedupe(spark):
    rows = [(1.0, "x"), (1.0, "x"), (math.nan, "y"), (None, "y"), (math.inf, "y"), (1.0, "X")]
    out = clean(spark.createDataFrame(rows, "a double, b string").coalesce(1), ["dedupe"]).collect()
    assert len(out) == 3
    kept = next(r["a"] for r in out if r["b"] == "y")
    assert math.isnan(kept)  # the first of the three


def test_dedupe_extensions(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, o int")
    assert sorted(r["v"] for r in dedupe(df, "last", ["k"], "o").collect()) == ["b", "c"]
    assert sorted(r["v"] for r in dedupe(df, "first", ["k"], "o").collect()) == ["a", "c"]
    assert [r["v"] for r in dedupe(df, "none", ["k"]).collect()] == ["c"]


def test_fill(spark):
    df = spark.createDataFrame([(1.0, "q", True, None), (None, None, None, None), (math.nan, "", False, None)], "n double, s string, b boolean, e string")
    rows = clean(df.coalesce(1), ["fill_missing"]).collect()
    assert [r["n"] for r in rows][:2] == [1.0, 0.0] and math.isnan(rows[2]["n"])
    assert [r["s"] for r in rows] == ["q", "", ""] and [r["b"] for r in rows] == ["true", "", "false"] and [r["e"] for r in rows] == [""] * 3


def test_order_of_operations(spark):
    df = spark.createDataFrame([(" a",), ("A",)], "s string")
    for ops in itertools.permutations(["trim", "normalize_case", "dedupe"]):
        assert [r["s"] for r in clean(df, ops).collect()] == ["A"]
    gaps = spark.createDataFrame([(None,), ("",)], "s string")
    assert [r["s"] for r in clean(gaps, ["fill_missing", "dedupe"]).collect()] == ["", ""]


def test_names_that_differ_by_case(spark):
    df = spark.createDataFrame([(" x", "y ")], "p string, q string").toDF("a", "A")
    out = clean(df, ["trim", "dedupe", "fill_missing"])
    assert out.columns == ["a", "A"] and tuple(out.first()) == ("x", "y")


def test_unknown_operation(spark):
    for ops in ([], ["shine"]):
        with pytest.raises(ValueError):
            clean(column(spark, ["a"]), ops)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=4), st.one_of(st.none(), st.floats(allow_nan=True))), max_size=6))
def test_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "s string, x double").coalesce(1)
    once = clean(df, ["trim", "dedupe"])
    twice = clean(once, ["trim", "dedupe"])
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
