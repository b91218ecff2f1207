"""Registered queries that write driver tables to a fresh layered store and read them back, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeflow.functions.display import kilobytes, shown_date, shown_megabytes
from lodeflow.operators import catalog, chart, clean, merge, validate
from lodeflow.operators.contracts import contract_table
from lodeflow.plans.queries import ORACLES, QUERIES, fresh_lake, query, read
from lodeflow.sources import names, store, versions
from lodeflow.streaming.incremental import progress, run_incremental

__all__ = ["ORACLES", "QUERIES"]


def _invoices(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select(day.alias("invoice_date"), F.col("o_orderpriority").alias("region"), F.col("o_custkey").alias("amount"), "o_orderkey")


def _one_text(spark, df, root, name):
    """A table as one CSV file, as an upload is."""
    return store.download(spark, root, "Silver", store.write_silver(df, root, name), f"{root}/uploads")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, o_orderpriority AS region, CAST(o_custkey AS VARCHAR) AS amount, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders")
def upload_and_read(spark, sf_dir):
    """Validated, copied unchanged to Bronze under its packed name, read by layer and name."""
    root = fresh_lake(spark)
    name = validate.ingest(spark, _one_text(spark, _invoices(spark, sf_dir), root, "orders"), root, "finance", "invoice_summary", now_ms=7)
    return store.read_dataset(spark, root, "Bronze", name, typed=False)


@query("SELECT 'finance__invoice_summary__orders_cleaned_7' AS name, true AS same, count(*) AS lines FROM orders")
def upload_unchanged(spark, sf_dir):
    """The name of an upload with its clock's suffix, and whether its bytes are those of the file."""
    root = fresh_lake(spark)
    path = _one_text(spark, _invoices(spark, sf_dir), root, "orders")
    name = validate.ingest(spark, path, root, "finance", "invoice_summary", now_ms=7)
    same = store.same_bytes(spark, path, names.path_of(root, "Bronze", name))
    lines = spark.read.text(path).agg((F.count("*") - 1).alias("lines"))
    return same.join(lines, how="cross").select(F.lit(name).alias("name"), "same", "lines")


_FIELDS = ("layer", "name", "display_name", "division", "owner", "rows", "columns", "status", "archived")


@query("""WITH n AS (SELECT count(*) AS c FROM orders), d AS (SELECT count(DISTINCT o_orderstatus) AS c FROM orders)
SELECT false AS all_, layer, name, display_name, division, owner, rows, columns, status, archived FROM (
SELECT 'Bronze' AS layer, 'finance__invoice_summary__orders_cleaned_7' AS name, 'Invoices' AS display_name, 'Finance' AS division, 'Ann' AS owner, c AS rows, 4 AS columns, 'Active' AS status, false AS archived FROM n
UNION ALL SELECT 'Bronze', 'other__kind__none', 'none', 'other', 'Workspace', 0, 2, 'Error', false
UNION ALL SELECT 'Silver', 'orders_cleaned_7_cleaned', 'Invoice Summary — orders_cleaned.csv (cleaned)', 'General', 'Workspace', c, 4, 'Active', false FROM n
UNION ALL SELECT 'Gold', 'by_status', 'by_status', 'General', 'Workspace', c, 2, 'Active', false FROM d)
UNION ALL SELECT true, 'Silver', 'orders_cleaned', 'orders_cleaned', 'General', 'Workspace', c, 4, 'Active', true FROM n""")
def catalog_of_lake(spark, sf_dir):
    """Uploaded, cleaned, renamed, archived and aggregated datasets, among files that are none; all_: archived ones."""
    root = fresh_lake(spark)
    name = validate.ingest(spark, _one_text(spark, _invoices(spark, sf_dir), root, "orders"), root, "finance", "invoice_summary", now_ms=7, owner="Ann")
    clean.prepare(spark, root, "Bronze", name, ["trim"])
    store.rename(spark, root, "Bronze", name, " Invoices ")
    store.archive(spark, root, "Silver", "orders_cleaned")
    store.write_gold(read(spark, sf_dir, "orders").groupBy("o_orderstatus").count(), root, "by status")
    store.put_text(spark, names.path_of(root, "Bronze", "other__kind__none"), "a,b\n")
    for stray in ("bronze_v3/other/loose.csv", "bronze_v3/other/kind/none.txt", "silver_v3/x/other.csv", "elsewhere/data.csv"):
        store.put_text(spark, f"{root}/{stray}", "a\n1\n")
    shown = catalog.catalog(spark, root).select(F.lit(False).alias("all_"), *_FIELDS)
    return shown.union(catalog.catalog(spark, root, include_archived=True).where("archived").select(F.lit(True), *_FIELDS))


@query("""SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_brand = 'Brand#1' AND contains(lower(p_name), 'e')
UNION ALL SELECT -p_partkey FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey + 1000000000 FROM part""")
def catalog_filters(spark, sf_dir):
    """Term, layer and division at once; a layer alone; nothing asked for."""
    k = F.col("p_size") % 3
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.lit("").alias("display_name"), F.col("p_brand").alias("division"), F.when(k == 0, "Bronze").when(k == 1, "Silver").otherwise("Gold").alias("layer"))
    id_ = F.col("p_partkey")
    return catalog.search(rows, "E", "Bronze", "Brand#1").select("p_partkey").union(catalog.search(rows, layer="Silver").select(-id_)).union(catalog.search(rows).select(id_ + 1_000_000_000))


@query("SELECT r_name || '.txt' AS file, length(r_name) AS length, r_name AS text FROM region")
def listing_and_text(spark, sf_dir):
    """A text file for each region: put, listed with its length, read."""
    root = fresh_lake(spark)
    regions = [r["r_name"] for r in read(spark, sf_dir, "region").select("r_name").collect()]
    for name in regions:
        store.put_text(spark, f"{root}/deep/{name}/{name}.txt", name)
    texts = spark.createDataFrame([(n, store.read_text(spark, f"{root}/deep/{n}/{n}.txt")) for n in regions], "name string, text string")
    files = store.listing(spark, root).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return files.join(texts, F.col("file") == F.concat("name", F.lit(".txt"))).select("file", "length", "text")


@query("SELECT 'there' AS place, true AS answers UNION ALL SELECT 'nowhere', false UNION ALL SELECT 'no such store', false")
def connection_test(spark, sf_dir):
    tests = {"there": f"{sf_dir}/region.parquet", "nowhere": f"{sf_dir}/nowhere", "no such store": "nosuch://host/x"}
    return spark.createDataFrame([(k, store.reachable(spark, v)) for k, v in tests.items()], "place string, answers boolean")


@query("""SELECT 'Bronze' AS layer, 'finance__kind__a__' || n_nationkey AS name, '/lake/bronze_v3/finance/kind/a__' || n_nationkey || '.csv' AS path FROM nation
UNION ALL SELECT 'Silver', 'n' || n_nationkey, '/lake/silver_v3/n' || n_nationkey || '/data.csv' FROM nation
UNION ALL SELECT 'Bronze', 'n' || n_nationkey, NULL FROM nation UNION ALL SELECT 'x', 'n' || n_nationkey, NULL FROM nation""")
def dataset_paths(spark, sf_dir):
    """Names to paths; no path for names that are not packed and for unknown layers."""

    def path(layer, name):
        try:
            return names.path_of("/lake/", layer, name)
        except ValueError:
            return None

    keys = [r[0] for r in read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    asked = [(layer, form.format(k)) for k in keys for layer, form in (("Bronze", "finance__kind__a__{}"), ("Silver", "n{}"), ("Bronze", "n{}"), ("x", "n{}"))]
    return spark.createDataFrame([(a, n, path(a, n)) for a, n in asked], "layer string, name string, path string")


@query("""SELECT 'Silver' AS layer, 'r__' || r_regionkey AS name, CASE WHEN r_regionkey = 1 THEN 'new' ELSE r_name END AS display_name, CASE WHEN r_regionkey = 2 THEN NULL ELSE 'Ann "x"' END AS owner, CAST(NULL AS VARCHAR) AS division_override, r_regionkey = 3 AS archived, false AS absent FROM region
UNION ALL SELECT 'Silver', 'none', NULL, NULL, NULL, NULL, true""")
def metadata_records(spark, sf_dir):
    """Records written, overwritten, renamed and archived, then read as one table; an absent one is empty."""
    root = fresh_lake(spark)
    for r in read(spark, sf_dir, "region").collect():
        k, name = r["r_regionkey"], f"r__{r['r_regionkey']}"
        store.save_metadata(spark, root, "Silver", name, {"display_name": "old"})
        store.save_metadata(spark, root, "Silver", name, {"display_name": r["r_name"], "archived": False} | ({} if k == 2 else {"owner": 'Ann "x"'}))
        if k == 1:
            store.rename(spark, root, "Silver", name, " new ")
        if k == 3:
            store.archive(spark, root, "Silver", name)
    none = store.load_metadata(spark, root, "Silver", "none")
    absent = spark.createDataFrame([("Silver", "none", none.get("display_name"), none.get("owner"), None, none.get("archived"))], f"layer string, name string, {store.METADATA_SCHEMA}")
    return store.metadata_table(spark, root).withColumn("absent", F.lit(False)).union(absent.withColumn("absent", F.lit(True)))


@query("""SELECT 'full' AS file, true AS ok, (SELECT count(*) FROM orders) || ' data row(s) found.' AS message
UNION ALL SELECT 'full', true, 'No duplicate columns.' UNION ALL SELECT 'full', true, 'All required columns present (invoice_date, region, amount).'
UNION ALL SELECT 'renamed', true, (SELECT count(*) FROM orders) || ' data row(s) found.'
UNION ALL SELECT 'renamed', true, 'No duplicate columns.' UNION ALL SELECT 'renamed', false, 'Missing required column(s): region, amount'
UNION ALL SELECT 'twice', false, 'File has a header but no data rows.' UNION ALL SELECT 'twice', false, 'Duplicate column(s): region' UNION ALL SELECT 'twice', true, 'All required columns present (invoice_date, region, amount).'
UNION ALL SELECT 'empty', false, 'File is empty.' UNION ALL SELECT 'unknown', false, 'Choose a division and dataset type first.'""")
def validate_files(spark, sf_dir):
    """All orders as a file that is right and as one that lacks columns; a header alone; a blank file; no such type."""
    root, rows = fresh_lake(spark), _invoices(spark, sf_dir)
    made = {"full": _one_text(spark, rows, root, "full"), "renamed": _one_text(spark, rows.toDF("invoice_date", "a", "b", "c"), root, "renamed")}
    for name, text in (("twice", "invoice_date, region ,amount,region\r\n  \r\n"), ("empty", " \n")):
        made[name] = f"{root}/uploads/{name}.csv"
        store.put_text(spark, made[name], text)
    found = [validate.validate_file(spark, path, "finance", "invoice_summary").withColumn("file", F.lit(name)) for name, path in made.items()]
    return store.union_all([*found, validate.validate_file(spark, made["full"], "finance", "nothing").withColumn("file", F.lit("unknown"))])


@query("""SELECT unnest(['no operation', 'unknown operation', 'one dataset', 'no measure', 'no number', 'empty name', 'bad upload', 'unknown layer']) AS guard, true AS raised""")
def guards(spark, sf_dir):
    """What is refused: each call ends in an error that names the fault."""
    root, orders = fresh_lake(spark), read(spark, sf_dir, "orders")
    path = _one_text(spark, orders.select("o_orderkey"), root, "orders")
    calls = {
        "no operation": lambda: clean.clean(orders, []),
        "unknown operation": lambda: clean.clean(orders, ["polish"]),
        "one dataset": lambda: merge.merge_datasets(spark, root, ("Silver", "orders_cleaned"), ("Silver", "orders_cleaned")),
        "no measure": lambda: chart.chart(orders, "o_orderstatus", ""),
        "no number": lambda: chart.chart(orders, "o_orderkey", "o_orderpriority"),
        "empty name": lambda: store.rename(spark, root, "Silver", "orders_cleaned", "  "),
        "bad upload": lambda: validate.ingest(spark, path, root, "finance", "invoice_summary"),
        "unknown layer": lambda: store.read_dataset(spark, root, "Lead", "orders_cleaned"),
    }

    def raised(call) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, raised(f)) for k, f in calls.items()], "guard string, raised boolean")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS orders FROM orders GROUP BY 1, 2")
def gold_write(spark, sf_dir):
    """Extension: an aggregate as a flat Parquet table of the Gold layer, read by its path."""
    root = fresh_lake(spark)
    sums = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))
    store.write_gold(sums, root, "orders by status")
    return spark.read.parquet(f"{root}/gold_v3/orders_by_status/data.parquet")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '—' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events")
def shown_dates(spark, sf_dir):
    then = F.when(F.col("event_type") != "error", F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", shown_date(then).alias("shown"))


@query("SELECT doc_id, format('{:.1f} MB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) AS mb, format('{:.0f} KB', floor(n_chars / 32.0 + 0.75)) AS kb FROM documents")
def shown_sizes(spark, sf_dir):
    """Sizes with one decimal in MB, with none in KB; halves go up."""
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").select("doc_id", shown_megabytes(n * 1024).alias("mb"), kilobytes(n * 32 + 256).alias("kb"))


@query("""SELECT c_custkey + 0.0::DOUBLE AS whole, c_acctbal::DOUBLE AS decimal_, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS flag, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'x' END AS mixed, CASE WHEN c_custkey % 2 = 0 THEN 'number' ELSE 'string' END AS kind FROM customer""")
def csv_typed(spark, sf_dir):
    """Columns of numbers and of booleans get their types, mixed ones stay cells of several kinds."""
    from lodeflow.functions.cells import text_kind

    k = F.col("c_custkey")
    root = fresh_lake(spark)
    flag = F.when(k % 5 != 0, F.when(k % 2 == 0, "true").otherwise("FALSE"))
    rows = read(spark, sf_dir, "customer").select(k.alias("whole"), F.col("c_acctbal").alias("decimal_"), flag.alias("flag"), F.when(k % 2 == 0, k.cast("string")).otherwise("x").alias("mixed"))
    back = store.read_dataset(spark, root, "Silver", store.write_silver(rows, root, "typed"))
    return back.withColumn("kind", text_kind(F.col("mixed")))


@query("SELECT c_custkey % 2 AS batch, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS segment FROM customer")
def incremental_flow(spark, sf_dir):
    """Extension: half of the customers, each twice, then the other half as a second file; a third run finds nothing."""
    root = fresh_lake(spark)
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("segment"))
    for half in (0, 1):
        part = rows.where(F.col("k") % 2 == half)
        path = _one_text(spark, part.union(part), root, f"half{half}")
        store.copy_file(spark, path, f"{root}/in/half{half}.csv")
        run_incremental(spark, f"{root}/in", ["k", "segment"], f"{root}/out", f"{root}/mark")
    run_incremental(spark, f"{root}/in", ["k", "segment"], f"{root}/out", f"{root}/mark")
    return spark.read.parquet(f"{root}/out").select(F.col("batch").cast("long").alias("batch"), "k", "segment")


@query("SELECT 0 AS batch, count(*) AS rows FROM nation")
def incremental_progress(spark, sf_dir):
    """Extension: what the monitor shows of a run."""
    root = fresh_lake(spark)
    path = _one_text(spark, read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), root, "nation")
    store.copy_file(spark, path, f"{root}/in/nation.csv")
    done = progress(run_incremental(spark, f"{root}/in", ["n_nationkey", "n_name"], f"{root}/out", f"{root}/mark"))
    return spark.createDataFrame([(p["batch"], p["rows"]) for p in done if p["rows"]], "batch long, rows long")


@query("SELECT 'first' AS read_, 1 AS datasets UNION ALL SELECT 'again', 1 UNION ALL SELECT 'after a change', 2")
def catalog_kept(spark, sf_dir):
    """The kept catalog stays as it is until it is dropped, as cleaning does."""
    root = fresh_lake(spark)
    kept = catalog.KeptCatalog(spark, root)
    nation = read(spark, sf_dir, "nation")
    store.write_silver(nation, root, "nation")
    seen = [("first", kept.get().count())]
    store.write_silver(nation, root, "second")
    seen.append(("again", kept.get().count()))
    kept.drop()
    seen.append(("after a change", kept.get().count()))
    kept.drop()
    return spark.createDataFrame(seen, "read_ string, datasets long")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1")
def clean_keep_none(spark, sf_dir):
    """Extension: orders that share customer and priority with no other."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return clean.dedupe(rows, "none", ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey")


@query("""SELECT label, total FROM (SELECT o_orderstatus AS label, count(*) * 0.0 AS total, min(o_orderkey) AS first_ FROM orders GROUP BY 1)
UNION ALL SELECT label, total FROM (SELECT CAST(o_custkey AS VARCHAR) AS label, 1.0 * count(DISTINCT 1) AS total, min(o_orderkey) AS first_ FROM orders GROUP BY 1 ORDER BY first_ LIMIT 20)""")
def chart_first_appearance(spark, sf_dir):
    """Equal totals: the groups that appear first, by an order column, are shown."""
    rows = read(spark, sf_dir, "orders").withColumn("zero", F.lit(0.0))
    first = F.row_number().over(_first_window()) == 1
    ones = rows.withColumn("one", F.when(first, 1.0).otherwise(0.0))
    return chart.group_sum(rows, "o_orderstatus", "zero", order="o_orderkey").union(chart.group_sum(ones, "o_custkey", "one", order="o_orderkey"))


def _first_window():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


@query("""WITH c(division_id, type_id, required) AS (VALUES ('finance', 'invoice_summary', 'invoice_date,region,amount'), ('customer_service', 'satisfaction_survey', 'survey_date,customer_id,score')),
a AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'customer_service' ELSE 'finance' END AS division_id, CASE n_nationkey % 3 WHEN 0 THEN 'invoice_summary' WHEN 1 THEN 'satisfaction_survey' ELSE 'nothing' END AS type_id FROM nation)
SELECT n_nationkey, division_id, type_id, required FROM a LEFT JOIN c USING (division_id, type_id)""")
def contract_lookup(spark, sf_dir):
    """Each nation asks for a contract; a third of them for one that doesn't exist."""
    k = F.col("n_nationkey") % 3
    asked = read(spark, sf_dir, "nation").select("n_nationkey", F.when(k == 1, "customer_service").otherwise("finance").alias("division_id"), F.when(k == 0, "invoice_summary").when(k == 1, "satisfaction_survey").otherwise("nothing").alias("type_id"))
    known = contract_table(spark).select("division_id", "type_id", F.array_join("required_columns", ",").alias("required"))
    return asked.join(F.broadcast(known), ["division_id", "type_id"], "left").select("n_nationkey", "division_id", "type_id", "required")


@query("""SELECT 'first' AS read_, o_orderstatus, count(*) AS rows FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2
UNION ALL SELECT 'second', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'second by number', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'last', 'x' || o_orderstatus, count(*) FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 2
UNION ALL SELECT 'listed', 'orders_cleaned', count(*) FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'conflicts', NULL, 1""")
def silver_versions(spark, sf_dir):
    """A cleaned dataset written three times, the last time from itself: a reader of the first version keeps it while the
    others are written, versions are read by number, the catalog counts the current one, a stale write is refused."""
    root, orders = fresh_lake(spark), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    by_status = lambda df, label: df.groupBy("o_orderstatus").agg(F.count("*").alias("rows")).select(F.lit(label).alias("read_"), "o_orderstatus", "rows")
    name = store.write_silver(orders.where("o_orderkey % 2 = 0"), root, "orders")
    first = store.read_dataset(spark, root, "Silver", name)
    store.write_silver(orders, root, "orders")
    number = versions.version(spark, root, "Silver", name)
    second = store.read_dataset(spark, root, "Silver", name)
    third = second.where(F.col("o_orderkey") % 3 == 0).withColumn("o_orderstatus", F.concat(F.lit("x"), "o_orderstatus"))
    store.write_silver(third, root, "orders", based_on=number)
    refused = 0
    try:
        store.write_silver(orders, root, "orders", based_on=number)
    except versions.Conflict:
        refused = 1
    listed = catalog.catalog(spark, root).select(F.lit("listed"), "name", "rows")
    shown = [by_status(first, "first"), by_status(second, "second"), by_status(store.read_dataset(spark, root, "Silver", name, version=number), "second by number"), by_status(store.read_dataset(spark, root, "Silver", name), "last"), listed]
    for df in shown[1:]:
        shown[0] = shown[0].union(df)
    return shown[0].union(spark.createDataFrame([("conflicts", None, refused)], "read_ string, o_orderstatus string, rows long"))
