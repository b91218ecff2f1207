import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lodeflow.operators import catalog
from lodeflow.sources import names, store
from lodeflow.sources.shared import shared_path


def listed(spark, root):
    return store.listing(spark, root).where(F.col("path").endswith(".csv")).select("path", F.col("modificationTime").alias("modified"), "length")


def test_only_changed_files_are_read(spark):
    root = shared_path(spark, "a lake+b")
    for k in range(6):
        store.put_text(spark, names.path_of(root, "Bronze", f"finance__kind__f{k}"), "a,b\n" + '1,"x\ny"\n' * k)
    kept = catalog.KeptCounts(spark, f"{root}/{catalog.COUNTS}")
    assert kept.follow(listed(spark, root)) == 6 and kept.follow(listed(spark, root)) == 0
    path = names.path_of(root, "Bronze", "finance__kind__f3")
    store.put_text(spark, path, "a,b,c\n1,2,3\n")
    assert kept.follow(listed(spark, root)) == 1
    got = {r["name"]: (r["rows"], r["columns"], r["status"]) for r in catalog.catalog(spark, root).collect()}
    assert got == {f"finance__kind__f{k}": (k if k != 3 else 1, 2 if k != 3 else 3, "Active" if k else "Error") for k in range(6)}


def test_folders_of_counts_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FOLDERS", 2)
    monkeypatch.setattr(catalog, "CHUNK", 2)
    root = shared_path(spark, "lake")
    for k in range(7):
        store.put_text(spark, names.path_of(root, "Bronze", f"finance__kind__f{k}"), f"a\n{k}\n")
    kept = catalog.KeptCounts(spark, f"{root}/{catalog.COUNTS}")
    assert kept.follow(listed(spark, root)) == 7
    assert len(kept._folders()) == 1 and kept.read().count() == 7


def test_counts_of_blocks(spark):
    root = shared_path(spark, "lake")
    path = names.path_of(root, "Bronze", "finance__kind__long")
    store.put_text(spark, path, 'a,"b,\nc"\n' + "".join(f'{i},"x\n\n{i}"\n' for i in range(500)))
    own = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        r = catalog.catalog(spark, root).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own[0])
        spark.conf.set("spark.sql.files.openCostInBytes", own[1])
    assert (r["rows"], r["columns"]) == (500, 2)
    assert os.path.exists(path.removeprefix("file://"))


def test_two_writers_lose_nothing(spark):
    """Many renames and an archiving of one dataset at once: the record keeps all fields, and the last name."""
    root = shared_path(spark, "lake")
    store.save_metadata(spark, root, "Silver", "x", {"display_name": "old", "owner": "Ann", "archived": False, "division_override": "Finance"})
    calls = [lambda: store.archive(spark, root, "Silver", "x"), *[lambda k=k: store.rename(spark, root, "Silver", "x", f"n{k}") for k in range(6)], lambda: store.save_metadata(spark, root, "Silver", "y", {"display_name": "other"})]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda f: f(), calls))
    found = {r["name"]: r for r in store.metadata_table(spark, root).collect()}
    x = found["x"]
    assert (x["owner"], x["archived"], x["division_override"]) == ("Ann", True, "Finance") and x["display_name"] in {f"n{k}" for k in range(6)}
    assert found["y"]["display_name"] == "other" and store.load_metadata(spark, root, "Silver", "y") == {"display_name": "other"}
    log = store.metadata_log(spark, root)
    assert log.version() == 8
    store.compact_metadata(spark, root)
    store.rename(spark, root, "Silver", "y", "later")
    store.compact_metadata(spark, root)
    assert {r["name"]: r["display_name"] for r in store.metadata_table(spark, root).collect()} == {"x": x["display_name"], "y": "later"}
    assert store.load_metadata(spark, root, "Silver", "x") == {"display_name": x["display_name"], "owner": "Ann", "division_override": "Finance", "archived": True}
    store.save_metadata(spark, root, "Silver", "x", {"owner": "Bo"})  # a whole record replaces all fields
    assert store.load_metadata(spark, root, "Silver", "x") == {"owner": "Bo"}
    assert {r["name"]: r["display_name"] for r in store.metadata_table(spark, root).collect()} == {"x": None, "y": "later"}


def test_records_of_plain_files_are_read(spark):
    """Records that other programs keep, one JSON file each, are there until a change replaces them."""
    root = shared_path(spark, "lake")
    store.put_text(spark, names.metadata_path(root, "Silver", "a__b"), '{"display_name": "plain", "owner": "Ann"}')
    store.put_text(spark, names.metadata_path(root, "Silver", "broken"), "{")
    assert store.load_metadata(spark, root, "Silver", "a__b") == {"display_name": "plain", "owner": "Ann"}
    store.archive(spark, root, "Silver", "a__b")
    assert store.load_metadata(spark, root, "Silver", "a__b") == {"display_name": "plain", "owner": "Ann", "archived": True}
    assert store.load_metadata(spark, root, "Silver", "none") == {} == store.load_metadata(spark, root, "Silver", "broken")
