"""Registered queries about rows' places in files, and about cells of several kinds, with DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeflow.operators import catalog, chart, clean, merge
from lodeflow.plans.queries import fresh_lake, query, read
from lodeflow.sources import store
from lodeflow.sources.records import ROW, numbered


def _placed(df, order):
    """df with each row's place in an order; the lake is written in it, in as many parts as there are."""
    return df.withColumn(ROW, order)


_NOTE_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'line' || chr(10) || '\"two\"' WHEN 1 THEN ',' || chr(10) || chr(10) || o_orderkey WHEN 2 THEN '\"' WHEN 3 THEN ' a,\"b\" ' ELSE 'plain' END"


def _note():
    k = F.col("o_orderkey") % 5
    return F.when(k == 0, 'line\n"two"').when(k == 1, F.concat(F.lit(",\n\n"), F.col("o_orderkey").cast("string"))).when(k == 2, '"').when(k == 3, ' a,"b" ').otherwise("plain")


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place, CAST(o_orderkey AS VARCHAR) AS o_orderkey, {_NOTE_SQL} AS note FROM orders")
def csv_split_quotes(spark, sf_dir):
    """Cells with quotes, commas and line feeds in a CSV dataset of several parts, read in blocks: all cells and all places."""
    root = fresh_lake(spark)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", _note().alias("note"))
    name = store.write_silver(_placed(rows, -F.col("o_orderkey")), root, "notes")
    return store.read_dataset(spark, root, "Silver", name, typed=False, ordered=True).withColumnRenamed(ROW, "place")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS label, 2.0::DOUBLE AS total FROM (SELECT o_custkey, min(-o_orderkey) AS first_ FROM orders GROUP BY 1) ORDER BY first_ LIMIT 20""")
def chart_file_order(spark, sf_dir):
    """Groups of equal totals: those that a CSV dataset of several parts shows first, without an order given."""
    root = fresh_lake(spark)
    orders = read(spark, sf_dir, "orders")
    tops = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.max("o_orderkey").alias("top"))
    # each customer's total is 2, by its first row alone
    rows = orders.join(tops, F.col("o_custkey") == F.col("c")).select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") == F.col("top"), 2).otherwise(0).alias("amount"))
    name = store.write_silver(_placed(rows, -F.col("o_orderkey")), root, "amounts")
    return chart.chart_dataset(spark, root, "Silver", name, "o_custkey", "amount")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders ORDER BY orders.o_orderkey % 1000 DESC, orders.o_orderkey LIMIT 15")
def preview_file_order(spark, sf_dir):
    """The first 15 rows of a CSV dataset of several parts, as its files have them."""
    root = fresh_lake(spark)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    name = store.write_silver(_placed(rows, F.struct(-(F.col("o_orderkey") % 1000), "o_orderkey")), root, "shuffled")
    return merge.preview_dataset(spark, root, "Silver", name)


@query("""SELECT cell, status FROM (SELECT *, row_number() OVER (PARTITION BY CAST(cell AS DOUBLE), status ORDER BY o_orderkey) AS n
FROM (SELECT o_orderkey, o_orderstatus AS status, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_custkey || '.0' ELSE o_custkey || '.00' END AS cell FROM orders)) WHERE n = 1""")
def dedupe_file_order(spark, sf_dir):
    """Of cells that read alike the first spelling in the files stays."""
    root, k, c = fresh_lake(spark), F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    cell = F.when(k == 0, c).when(k == 1, F.concat(c, F.lit(".0"))).otherwise(F.concat(c, F.lit(".00")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell"), F.col("o_orderstatus").alias("status"))
    name = store.write_silver(_placed(rows, F.col("o_orderkey")).drop("o_orderkey"), root, "cells")
    placed = store.read_dataset(spark, root, "Silver", name, typed=False, ordered=True)
    return clean.clean(placed, ["dedupe"], cells=True).drop(ROW)


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS i, o_custkey AS k, o_orderkey FROM orders),
b AS (SELECT row_number() OVER (ORDER BY c_custkey DESC) AS j, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000000 END AS k, c_name FROM customer)
SELECT row_number() OVER (ORDER BY i NULLS LAST, j NULLS FIRST) - 1 AS place, CAST(coalesce(a.k, b.k) AS DOUBLE) AS k, CAST(o_orderkey AS DOUBLE) AS o_orderkey, c_name FROM a FULL JOIN b ON a.k = b.k""")
def merge_file_order(spark, sf_dir):
    """An outer merge of two CSV datasets: the first's rows in order, then those of the second that match none."""
    root = fresh_lake(spark)
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (-F.col("o_orderkey")).alias(ROW))
    k = F.col("c_custkey")
    b = read(spark, sf_dir, "customer").select(F.when(k % 2 == 0, k).otherwise(k + 1_000_000_000).alias("k"), "c_name", (-k).alias(ROW))
    one, two = (("Silver", store.write_silver(df, root, name)) for df, name in ((a, "a"), (b, "b")))
    out = merge.merge_datasets(spark, root, one, two, "outer")
    return numbered(out, ROW, "place").drop(ROW)


#: A column with booleans and numbers among others, as a CSV file may have it.
_KINDS_SQL = "CASE o_orderkey % 10 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'n/A' ELSE CAST(o_custkey AS VARCHAR) END"


def _kinds():
    k = F.col("o_orderkey") % 10
    return F.when(k == 0, "TRUE").when(k == 1, "false").when(k == 2, "n/A").otherwise(F.col("o_custkey").cast("string"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 2 THEN 'N/a' ELSE {_KINDS_SQL} END AS cell FROM orders")
def clean_case_mixed(spark, sf_dir):
    """Booleans and numbers among texts keep their spelling; texts are cased."""
    return clean.clean(read(spark, sf_dir, "orders").select("o_orderkey", _kinds().alias("cell")), ["normalize_case"], cells=True)


@query("SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 'NaN'::DOUBLE ELSE o_custkey END::DOUBLE AS cell FROM orders")
def clean_fix_mixed(spark, sf_dir):
    """Booleans count as numbers in the vote, which only they bring over 80 %, and become 1 and 0."""
    return clean.clean(read(spark, sf_dir, "orders").select("o_orderkey", _kinds().alias("cell")), ["fix_types"], cells=True)


@query("SELECT o_orderstatus AS label, round(sum(CASE o_orderkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE o_custkey END), 2)::DOUBLE AS total FROM orders GROUP BY 1")
def chart_mixed_booleans(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", _kinds().alias("cell"))
    return chart.chart(rows, "o_orderstatus", "cell", cells=True)


@query("""SELECT k, o_orderkey, c_custkey FROM (SELECT CAST(o_custkey AS VARCHAR) AS k, o_custkey, o_orderkey FROM orders) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) b ON a.o_custkey = b.c_custkey WHERE k IS NOT NULL
UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || '.000000000000000001' END, NULL, c_custkey FROM customer b WHERE c_custkey % 2 = 1 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def merge_wide_decimals(spark, sf_dir):
    """Keys of decimal(38,0) and decimal(38,18), which no decimal type holds together: equal numbers match, others don't."""
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("decimal(38,0)").alias("k"), "o_orderkey")
    c = F.col("c_custkey")
    wide = F.when(c % 2 == 0, c.cast("decimal(38,18)")).otherwise(F.concat(c.cast("string"), F.lit(".000000000000000001")).cast("decimal(38,18)"))
    return merge.merge(a, read(spark, sf_dir, "customer").select(wide.alias("k"), "c_custkey"), "outer")


@query("""SELECT 'first' AS look, 2 AS datasets_read, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'again', 0, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer)
UNION ALL SELECT 'after a change', 1, (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier)""")
def catalog_follows(spark, sf_dir):
    """Counts of two datasets; looked at again, nothing is read; after one is overwritten, only its files are."""
    root = fresh_lake(spark)
    kept = catalog.KeptCounts(spark, f"{root}/{catalog.COUNTS}")
    store.write_silver(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), root, "orders")
    store.write_silver(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), root, "second")
    looks = []
    for look in ("first", "again", "after a change"):
        if look == "after a change":
            store.write_silver(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), root, "second")
        before = {tuple(r) for r in kept.read().select("path", "modified").collect()}
        rows = catalog.catalog(spark, root).agg(F.sum("rows")).first()[0]
        new = {tuple(r) for r in kept.read().select("path", "modified").collect()} - before
        looks.append((look, len({p.rsplit("/", 1)[0] for p, _ in new}), rows))
    return spark.createDataFrame(looks, "look string, datasets_read int, rows long")
