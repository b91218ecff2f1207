import math

import pytest
from pyspark.sql import functions as F

from lodeflow.functions import cells


def values(spark, texts, change):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(change(F.col("t"))).collect()]


def test_trim(spark):
    assert values(spark, ["\t a ", "﻿ x \n", "\u0085c\u0085", "", None, "a b"], cells.trim) == ["a", "x", "\u0085c\u0085", "", None, "a b"]


def test_title_case(spark):
    given = ["(hELLO wORLD", "éCOLE ÉTÉ", "fOO\tbAR", "foo-BAR  o'NEIL", "--- ***", "", None]
    assert values(spark, given, cells.title_case) == ["(Hello World", "éCole ÉTé", "Foo\tBar", "Foo-bar  O'neil", "--- ***", "", None]


def test_numbers(spark):
    given = {"": 0, "   ": 0, "Infinity": math.inf, "0x1F": 31, "0b1": 1, "0o17": 15, " 12 ": 12, "5.": 5, ".5": 0.5, "+7": 7, "1e400": math.inf, "0xFFFFFFFFFFFFFFFFFF": float(0xFFFFFFFFFFFFFFFFFF)}
    assert values(spark, list(given), cells.text_number) == list(given.values())
    none = ["1d", "1f", "inf", "1_000", "-0x1", "0x", "abc", "."]
    assert all(math.isnan(v) for v in values(spark, none, cells.text_number))
    assert values(spark, [None], cells.text_number) == [None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, zone):
    good = ["2024-01-05", "2024/01/05", "01/05/2024", "1/5/2024", "5 Jan 2024", "Jan 5, 2024", "2024-01-05T23:30:00Z", "2024-01-05 10:00"]
    bad = ["2024-02-30", "2024-13-01", "Region 1", "abc", "12:30", "T10", "2024-01-05junk", "", None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert values(spark, good, cells.text_date) == ["2024-01-05"] * len(good)
        assert values(spark, ["2024-01-05T23:30:00-05:00"], cells.text_date) == ["2024-01-06"]
        assert values(spark, bad, cells.text_date) == [None] * len(bad)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_kinds(spark):
    given = ["1", "1.5e3", "true", "FALSE", "", None, "2024-01-05T10:00:00Z", "2024-01-05", "abc", "99999999999999999999"]
    assert values(spark, given, cells.text_kind) == ["number", "number", "boolean", "boolean", "null", "null", "datetime", "string", "string", "string"]
