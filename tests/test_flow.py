import random

import pytest
from pyspark.sql import functions as F

from lodeflow.operators import chart, clean, merge
from lodeflow.sources.shared import shared_path
from lodeflow.streaming.flow import Flow, Partials


def shown(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.fixture(scope="module")
def arrivals():
    """Four batches with repeated rows; column b is numeric over all, not in the first batch."""
    rng = random.Random(4)
    rows = [[(rng.choice([" a", "B", "c c"]), str(rng.randrange(6)) if rng.random() < (0.5 if k == 0 else 0.97) else rng.choice(["x", "y"] if k == 0 else ["x", "TRUE", "", "y"]), rng.choice(["1", "1.0", "t"])) for _ in range(12 if k == 0 else 60)] for k in range(4)]
    return rows


def put(spark, root, k, rows):
    spark.createDataFrame(rows, "a string, b string, c string").write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{root}/in/{k}")


@pytest.mark.parametrize("operations", [["trim", "normalize_case", "fix_types", "dedupe", "fill_missing"], ["dedupe"], ["fix_types"], ["trim", "fill_missing"]])
def test_batches_equal_one_pass(spark, arrivals, operations):
    root = shared_path(spark, "flow")
    flow = lambda: Flow(spark, f"{root}/in/*", ["a", "b", "c"], f"{root}/out", operations, [("a", "b")])
    assert flow().read().count() == 0 and flow().top("a", "b").count() == 0
    seen = []
    for k, rows in enumerate(arrivals):
        put(spark, root, k, rows)
        flow().run()
        if k in (1, 2):
            flow().fold()
        seen += [(a, b or None, c) for a, b, c in rows]
        whole = spark.createDataFrame(seen, "a string, b string, c string")
        want = clean.clean(whole, operations, cells=True)
        got = flow().read()
        assert got.schema.simpleString() == want.schema.simpleString()
        norm = lambda df: df.withColumn("c", F.regexp_replace("c", r"\.0$", "")) if "dedupe" in operations else df
        assert shown(norm(got).collect()) == shown(norm(want).collect())
        trimmed = clean.clean(whole, [o for o in operations if o in ("trim", "normalize_case")] or ["dedupe"], cells=True) if set(operations) & {"trim", "normalize_case"} else whole
        assert shown(flow().top("a", "b").collect()) == shown(chart.group_sum(trimmed, "a", "b", cells=True).collect())


def test_types_turn_when_votes_do(spark, arrivals):
    root = shared_path(spark, "flow")
    flow = Flow(spark, f"{root}/in/*", ["a", "b", "c"], f"{root}/out", ["fix_types"])
    kinds = []
    for k, rows in enumerate(arrivals):
        put(spark, root, k, rows)
        flow.run()
        kinds.append(dict(flow.read().dtypes)["b"])
    assert kinds[0] == "string" and kinds[-1] == "double"


def test_a_batch_run_again_counts_once(spark):
    path = shared_path(spark, "partials")
    kept = Partials(spark, path)
    one = lambda v: spark.createDataFrame([("k", float(v), 1)], "x string, total double, n long")
    add = lambda df: df.groupBy("x").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    total = lambda: add(kept.read()).first()["total"]
    assert kept.read() is None
    for n in range(3):
        kept.put(n, one(n + 1))
    kept.put(2, one(3))
    assert total() == 6
    kept.fold(add)
    kept.put(2, one(3))  # again, after the fold that covers it
    assert total() == 6 and kept.read().count() == 1
    kept.put(3, one(10))
    kept.fold(add)
    kept.fold(add)
    assert total() == 16 and kept._folders("batch") == [3]


def test_settings_and_names(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError):
        Flow(spark, "x", ["a"], "y", ["polish"])
    with pytest.raises(ValueError):
        Flow(spark, "x", ["a"], "y", ["trim"], [("a", "b")])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def sides(spark, rng, n, m):
    key = lambda hot: None if (x := rng.random()) < hot * 0.6 else "h" if x < hot else f"k{rng.randrange(50)}"
    a = spark.createDataFrame([(key(0.6), i) for i in range(n)], "k string, a int")
    b = spark.createDataFrame([(key(0.2), i) for i in range(m)] + [(f"z{i}", i) for i in range(30)], "k string, b int")
    return a, b


@pytest.mark.parametrize("how", list(merge.JOINS))
def test_spread_merges_are_equal(spark, how):
    a, b = sides(spark, random.Random(8), 300, 70)
    cases = [(a, b), (b.withColumnRenamed("b", "p"), a.withColumnRenamed("a", "q")), (a.where("k <> 'h'"), b.where("k is not null")), (a.limit(0), b), (a, b.limit(0))]
    for x, y in cases:
        assert shown(merge.merge(x, y, how, heavy=0.1).collect()) == shown(merge.merge(x, y, how).collect())
    mixed = a.withColumn("k", F.when(F.col("a") % 3 == 0, "1.0").otherwise(F.col("k")))
    numbers = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, n string")
    assert shown(merge.merge(mixed, numbers, how, cells=True, heavy=0.1).collect()) == shown(merge.merge(mixed, numbers, how, cells=True).collect())


def test_a_key_with_half_of_all_rows_is_spread(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    few = spark.createDataFrame([(None, 1), (3, 2)], "k long, n int")
    assert list(merge.heavy_keys(rows, F.col("k"), 0.05)) == ["{}"]
    left, right = merge.spread(rows, few, F.col("k"), F.col("k"), 0.05)
    sizes = [r["count"] for r in left.repartition(4, F.coalesce("k", F.lit(-1)), "salt_").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[2]
    assert right.count() == right.where("k is null").count() + 1 and right.where("k is null").count() > 4
