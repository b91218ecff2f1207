import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodeflow.functions.display import time_ago
from lodeflow.operators import catalog
from lodeflow.operators.clean import prepare
from lodeflow.operators.validate import header_and_count, ingest, validate_file
from lodeflow.sources import names, store
from lodeflow.streaming.incremental import progress, run_incremental


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return f"file://{path}"


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("", ["File is empty."]),
        ("invoice_date,region\na,b\n", ["Missing required column(s): amount"]),
        ("invoice_date,region,amount,region\na,b,1,c\n", ["Duplicate column(s): region"]),
        (" invoice_date ,region,amount\n", ["File has a header but no data rows."]),
        ("invoice_date,region,amount\r\na,b,1\r\n   \r\n", []),
    ],
)
def test_validation(spark, tmp_path, text, bad):
    out = validate_file(spark, write(tmp_path, "f.csv", text), "finance", "invoice_summary").collect()
    assert [r["message"] for r in out if not r["ok"]] == bad


def test_header_is_the_first_blocks(spark):
    """Blocks that come in any order: the header is the first line of the file, not of what is read first."""
    lines = spark.createDataFrame([(70, "5,6"), (0, "a,b"), (0, "1,2"), (35, " "), (35, "3,4")], "block long, line string").coalesce(1)
    assert tuple(header_and_count(lines).first()) == ("a,b", 3)
    assert tuple(header_and_count(lines.limit(0)).first()) == (None, -1)


def test_unknown_type(spark, tmp_path):
    out = validate_file(spark, write(tmp_path, "f.csv", "a\n1"), "finance", "nothing").collect()
    assert [r["ok"] for r in out] == [False]


def test_names(spark):
    given = {"  My File (1)": "My_File_1", "___": "dataset", "é": "dataset", "a__b": "a__b"}
    df = spark.createDataFrame([(k,) for k in given], "s string")
    assert [r[0] for r in df.select(names.sanitize(F.col("s"))).collect()] == list(given.values())
    assert [names.sanitized(k) for k in given] == list(given.values())
    assert names.bronze_parts("finance__invoice_summary__a__b") == ("finance", "invoice_summary", "a__b")
    with pytest.raises(ValueError):
        names.path_of("r", "Bronze", "a__b")


def test_times(spark):
    now = dt.datetime(2024, 1, 31)
    ages = {59: "just now", 60: "1 minute ago", 119: "1 minute ago", 3600: "1 hour ago", 86399: "23 hours ago", 86400: "1 day ago", 172800: "2 days ago"}
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s),) for s in ages], "t timestamp")
    assert [r[0] for r in df.select(time_ago(F.col("t"), F.lit(now))).collect()] == list(ages.values())


def test_csv_round_trip(spark, tmp_path):
    rows = [(0, " pad "), (1, "a,b"), (2, 'q"q'), (3, "two\nlines"), (4, ""), (5, None)]
    store.write_csv(spark.createDataFrame(rows, "i int, s string"), f"file://{tmp_path}/t")
    back = store.read_csv(spark, f"file://{tmp_path}/t").orderBy("i").collect()
    assert [r["s"] for r in back] == [" pad ", "a,b", 'q"q', "two\nlines", None, None] and back[0]["i"] == 0.0


def test_layers_from_upload_to_catalog(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    path = write(tmp_path, "May (1).csv", "invoice_date,region,amount\n2024-05-01, north ,10\n2024-05-01,north,10\n2024-05-02,south,x\n")
    name = ingest(spark, path, root, "finance", "invoice_summary", now_ms=7)
    assert name == "finance__invoice_summary__May_1_7"
    assert (tmp_path / "lake/bronze_v3/finance/invoice_summary/May_1_7.csv").read_bytes() == (tmp_path / "May (1).csv").read_bytes()
    silver = prepare(spark, root, "Bronze", name, ["dedupe", "trim"])
    assert silver == "May_1_7_cleaned" and store.read_dataset(spark, root, "Silver", silver).count() == 2
    write(tmp_path / "lake/bronze_v3/finance/invoice_summary", "none.csv", "invoice_date,region,amount\n")
    found = {r["name"]: r for r in catalog.catalog(spark, root).collect()}
    assert set(found) == {name, silver, "finance__invoice_summary__none"}
    assert found[name]["division"] == "Finance" and found[name]["rows"] == 3 and found[name]["columns"] == 3 and found[name]["status"] == "Active"
    assert found[name]["display_name"] == "Invoice Summary — May (1).csv" and found[silver]["division"] == "General"
    assert found["finance__invoice_summary__none"]["status"] == "Error" and found["finance__invoice_summary__none"]["display_name"] == "none" and found["finance__invoice_summary__none"]["owner"] == "Workspace"
    store.rename(spark, root, "Silver", silver, "  May  ")
    store.archive(spark, root, "Bronze", name)
    after = {r["name"]: r for r in catalog.catalog(spark, root).collect()}
    assert name not in after and after[silver]["display_name"] == "May"
    assert {r["name"] for r in catalog.search(catalog.catalog(spark, root), "%").collect()} == set()
    store.write_gold(spark.range(5).withColumn("x", F.col("id")), root, "sums of May")
    gold = {r["name"]: r for r in catalog.catalog(spark, root).collect()}["sums_of_May"]
    assert (gold["layer"], gold["rows"], gold["columns"], gold["status"]) == ("Gold", 5, 2, "Active")
    totals = catalog.totals(catalog.catalog(spark, root)).first()
    assert totals["total_datasets"] == 3 and totals["storage_used_mb"] > 0
    assert [r["division"] for r in catalog.divisions(catalog.catalog(spark, root)).collect()] == ["Finance", "General"]
    assert store.download(spark, root, "Bronze", name, f"file://{tmp_path}/out").endswith("/May_1_7.csv")
    assert store.reachable(spark, root) and not store.reachable(spark, f"{root}/nowhere")
    with pytest.raises(ValueError):
        store.rename(spark, root, "Silver", silver, "  ")
    with pytest.raises(ValueError):
        ingest(spark, write(tmp_path, "bad.csv", "a\n1\n"), root, "finance", "invoice_summary")


def test_incremental(spark, tmp_path):
    folder, target, mark = tmp_path / "in", f"{tmp_path}/silver", f"{tmp_path}/mark"
    folder.mkdir()
    write(folder, "a.csv", "k,v\n1, x \n1,x\n")
    query = run_incremental(spark, str(folder), ["k", "v"], target, mark)
    assert progress(query)[0]["rows"] == 2
    write(folder, "b.csv", "k,v\n2,y\n")
    run_incremental(spark, str(folder), ["k", "v"], target, mark)
    run_incremental(spark, str(folder), ["k", "v"], target, mark)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect()) == [("1", "x"), ("2", "y")]


def test_download_of_parts(spark, tmp_path):
    """Parts put together by tasks and the file system have the bytes that the stream gives; parts of many blocks too."""
    root = f"file://{tmp_path}/lake"
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit('x\n"'), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, F.concat(F.lit(" é,"), F.col("id").cast("string"))).otherwise(F.lit(None))
    rows = spark.range(700).select("id", text.alias('two\nlines, "quoted"'), F.lit("k").alias("k")).repartition(5)
    name = store.write_silver(rows, root, "a")
    own = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = store.download(spark, root, "Silver", name, f"file://{tmp_path}/out")
        again = store.download(spark, root, "Silver", name, f"file://{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own[0])
        spark.conf.set("spark.sql.files.openCostInBytes", own[1])
    fs, p = store.file_system(spark, store.dataset_path(spark, root, "Silver", name))
    parts = sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    store._streamed(spark, parts, f"file://{tmp_path}/streamed.csv")
    assert len(parts) > 1 and got == again
    assert (tmp_path / "out" / f"{name}.csv").read_bytes() == (tmp_path / "streamed.csv").read_bytes()
    assert [f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")] == [f"{name}.csv"]
    assert store.read_csv(spark, got).count() == 700
    # only headers; one part
    for k, rows in enumerate((rows.where("id < 0"), rows.where("id < 3").coalesce(1))):
        assert store.read_csv(spark, store.download(spark, root, "Silver", store.write_silver(rows, root, f"few{k}"), f"file://{tmp_path}/out")).count() == 3 * k


def test_csv_is_read_in_blocks(spark, tmp_path):
    """A dataset without places is read by many tasks too, cells with line feeds included."""
    rows = "".join(f'{i},"two\nlines {i}"\n' for i in range(400))
    path = write(tmp_path, "f.csv", f"k,note\n{rows}")
    own = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = store.read_csv(spark, path, typed=False)
        assert df.columns == ["k", "note"] and df.rdd.getNumPartitions() > 1
        assert sorted(tuple(r) for r in df.collect()) == sorted((str(i), f"two\nlines {i}") for i in range(400))
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def test_same_bytes(spark, tmp_path):
    """Compared in blocks, none of which is a file: one byte, an encoding, a line's end and a length apart."""
    base = b"a,b\r\n" + b"".join(b"%d,\xff\xfe\n" % i for i in range(500))
    others = {"same": base, "byte": base[:2000] + b"#" + base[2001:], "swapped": base[:5] + base[10:15] + base[5:10] + base[15:], "end": base[:-1] + b" ", "longer": base + b"\n", "nothing": b""}
    for name, content in {"base": base, "void": b"", **others}.items():
        (tmp_path / name).write_bytes(content)
    own = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        same = {n: store.same_bytes(spark, f"file://{tmp_path}/base", f"file://{tmp_path}/{n}") for n in others}
        assert {n: df.first()["same"] for n, df in same.items()} == {n: n == "same" for n in others}
        assert store.same_bytes(spark, f"file://{tmp_path}/void", f"file://{tmp_path}/nothing").first()["same"]
        assert "binaryFile" not in same["same"]._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
