from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodeflow.operators import catalog
from lodeflow.sources import names, store, versions
from lodeflow.sources.shared import shared_path


def numbers(spark, root, name, version=None):
    return sorted(int(r["n"]) for r in store.read_dataset(spark, root, "Silver", name, typed=False, version=version).collect())


def test_a_reader_keeps_its_version_while_another_is_written(spark):
    root = shared_path(spark, "lake")
    name = store.write_silver(spark.range(3).toDF("n"), root, "a")
    first = versions.version(spark, root, "Silver", name)
    begun = store.read_dataset(spark, root, "Silver", name, typed=False)
    store.write_silver(spark.range(10, 14).toDF("n"), root, "a")
    assert sorted(int(r["n"]) for r in begun.collect()) == [0, 1, 2]
    assert numbers(spark, root, name) == [10, 11, 12, 13] and numbers(spark, root, name, first) == [0, 1, 2]
    # rows made of the dataset itself
    again = store.read_dataset(spark, root, "Silver", name).select((F.col("n") + 1).cast("int").alias("n"))
    store.write_silver(again, root, "a")
    assert numbers(spark, root, name) == [11, 12, 13, 14]


def test_a_failed_write_changes_nothing(spark):
    root = shared_path(spark, "lake")
    name = store.write_silver(spark.range(3).toDF("n"), root, "a")
    with pytest.raises(Exception, match="stop"):
        store.write_silver(spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("n")), root, "a")
    assert numbers(spark, root, name) == [0, 1, 2]
    entry = catalog.catalog(spark, root).first()
    assert (entry["name"], entry["rows"], entry["columns"]) == (name, 3, 1)


def test_writers_based_on_one_version(spark):
    root = shared_path(spark, "lake")
    name = store.write_silver(spark.range(1).toDF("n"), root, "a")
    store.write_silver(spark.range(1).toDF("n"), root, "b")
    base = versions.version(spark, root, "Silver", name)

    def write(k):
        try:
            store.write_silver(spark.createDataFrame([(k,)], "n int"), root, "a", based_on=base)
        except versions.Conflict:
            return None
        return k

    with ThreadPoolExecutor(5) as pool:
        won = [k for k in pool.map(write, range(5)) if k is not None]
    assert len(won) == 1 and numbers(spark, root, name) == won
    # another dataset's versions are no conflict
    assert store.write_silver(spark.range(2).toDF("n"), root, "b", based_on=versions.version(spark, root, "Silver", "b_cleaned")) == "b_cleaned"


def test_plain_files_until_a_version_is_there(spark):
    root = shared_path(spark, "lake")
    store.put_text(spark, names.path_of(root, "Silver", "a_cleaned"), "n\n5\n6\n")
    store.put_text(spark, names.path_of(root, "Silver", "plain"), "n\n1\n")
    assert numbers(spark, root, "a_cleaned") == [5, 6]
    store.write_silver(spark.range(4).toDF("n"), root, "a")
    assert numbers(spark, root, "a_cleaned") == [0, 1, 2, 3] and numbers(spark, root, "plain") == [1]
    assert {(r["name"], r["rows"]) for r in catalog.catalog(spark, root).collect()} == {("a_cleaned", 4), ("plain", 1)}


def test_old_versions_go(spark):
    root = shared_path(spark, "lake")
    for k in range(3):
        name = store.write_silver(spark.range(k + 1).toDF("n"), root, "a")
    assert versions.vacuum(spark, root) == 0 and numbers(spark, root, name, 0) == [0]
    versions.compact(spark, root)
    assert versions.vacuum(spark, root, -60) == 2
    assert numbers(spark, root, name) == [0, 1, 2] and versions.version(spark, root, "Silver", name) == 2
    store.write_silver(spark.range(5).toDF("n"), root, "a")
    assert numbers(spark, root, name) == [0, 1, 2, 3, 4] and versions.vacuum(spark, shared_path(spark, "none")) == 0
