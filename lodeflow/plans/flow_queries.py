"""Registered queries over incremental flows and skewed merges, with DuckDB SQL for them."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodeflow.operators import discover, merge
from lodeflow.plans.queries import fresh_lake, query, read
from lodeflow.sources.store import CSV_WRITE, put_text
from lodeflow.streaming.flow import Flow
from lodeflow.streaming.monitor import runs


def _arrives(df, root, batch):
    """Rows as a new folder of CSV files, as an upload brings them."""
    df.write.options(**CSV_WRITE).csv(f"{root}/in/{batch}")


def _batches(spark, sf_dir, columns, operations, sums=(), fold_after=None):
    """Three overlapping batches of orders, each taken by a flow of its own that starts where the last one ended."""
    root = fresh_lake(spark)
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k, *columns.values())
    for batch, part in enumerate((k % 4 <= 1, (k % 4 >= 1) & (k % 4 <= 2), k % 4 >= 1)):
        own = rows.where(part).drop("o_orderkey")
        _arrives(own.union(own.where("true")) if batch == 0 else own, root, batch)
        flow = Flow(spark, f"{root}/in/*", list(columns), f"{root}/out", operations, sums)
        flow.run()
        if batch == fold_after:
            flow.fold()
    Flow(spark, f"{root}/in/*", list(columns), f"{root}/out", operations, sums).run()  # finds nothing new
    return Flow(spark, f"{root}/in/*", list(columns), f"{root}/out", operations, sums)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS priority FROM orders")
def flow_dedupe(spark, sf_dir):
    """Extension: batches that overlap, one of them with every row twice, over restarts: each row once."""
    columns = {"k": F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("k"), "priority": F.col("o_orderpriority").alias("priority")}
    return _batches(spark, sf_dir, columns, ["trim", "dedupe"]).read()


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS late, CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS never FROM orders)
SELECT DISTINCT CASE WHEN late = 'n/a' THEN 'NaN'::DOUBLE ELSE CAST(late AS DOUBLE) END AS late, never, CASE WHEN o_orderkey % 16 = 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM t JOIN orders USING (o_orderkey)""")
def flow_votes(spark, sf_dir):
    """Extension: types by the votes of all batches, as one full pass has them. A quarter of the first batch's cells of one
    column are no numbers, of all batches' an eighth or less; another column stays text; spellings of days meet."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderdate")
    late = F.when(k % 8 == 0, "n/a").otherwise(c).alias("late")
    never = F.when(k % 4 % 2 == 1, F.col("o_orderstatus")).otherwise(c).alias("never")
    days = F.when(k % 16 == 3, "").when(k % 2 == 0, F.date_format(day, "yyyy/M/d")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("day")
    return _batches(spark, sf_dir, {"late": late, "never": never, "day": days}, ["trim", "fix_types", "dedupe", "fill_missing"]).read()


@query("""WITH b AS (SELECT o_custkey, o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 4 = 1 THEN 4 WHEN o_orderkey % 4 = 2 THEN 2 ELSE 1 END AS times FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS label, round(sum(round(o_totalprice, 2) * times), 2) AS total FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def flow_gold_sums(spark, sf_dir):
    """Extension: sums by key over all files that came, folded in between; read from the kept sums alone."""
    columns = {"c": F.col("o_custkey").cast("string").alias("c"), "price": F.round("o_totalprice", 2).cast("string").alias("price")}
    flow = _batches(spark, sf_dir, columns, ["trim"], [("c", "price")], fold_after=1)
    flow.fold()
    return flow.top("c", "price").withColumn("total", F.round("total", 2))


@query("""WITH a AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 7 ELSE o_custkey END AS k, o_orderkey FROM orders),
b AS (SELECT CASE WHEN c_custkey = 5 THEN NULL WHEN c_custkey = 6 THEN 7 ELSE c_custkey END AS k, c_name FROM customer)
SELECT coalesce(a.k, b.k) AS k, o_orderkey, c_name FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def merge_skewed_outer(spark, sf_dir):
    """An outer merge in which half of one side has no key and a quarter has one key: spread over many tasks."""
    n = F.col("o_orderkey")
    a = read(spark, sf_dir, "orders").select(F.when(n % 2 == 0, None).when(n % 4 == 1, 7).otherwise(F.col("o_custkey")).alias("k"), n)
    c = F.col("c_custkey")
    b = read(spark, sf_dir, "customer").select(F.when(c == 5, None).when(c == 6, 7).otherwise(c).alias("k"), "c_name")
    return merge.merge(a, b, "outer", heavy=0.05)


@query("SELECT 'first' AS job, 'ended' AS state, 2 AS runs, 2 AS batches, count(*) AS orders_kept FROM orders UNION ALL SELECT 'second', 'ended', 2, 2, count(*) FROM orders UNION ALL SELECT 'third', 'failed', 1, 0, count(*) FROM orders")
def job_monitor(spark, sf_dir):
    """Extension: what the monitor has of two runs and of one that fails, each of two streams at most."""
    root = fresh_lake(spark)
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.cast("string").alias("k"))
    flow = Flow(spark, f"{root}/in/*", ["k"], f"{root}/out", ["trim", "dedupe"])
    for batch, job in enumerate(("first", "second")):
        _arrives(rows.where(k % 2 == batch), root, batch)
        flow.run(f"{root}/jobs", job)
    put_text(spark, f"{root}/broken/votes", "a file where the votes' folder should be")
    try:
        Flow(spark, f"{root}/in/*", ["k"], f"{root}/broken", ["dedupe"]).run(f"{root}/jobs", "third")
    except StreamingQueryException:
        pass
    kept = flow.read().count()
    seen = runs(spark, f"{root}/jobs").groupBy("job", "state").agg(F.count("*").cast("int").alias("runs"), F.sum("batches").cast("int").alias("batches"))
    return seen.withColumn("orders_kept", F.lit(kept).cast("long"))


@query("""SELECT o_orderkey, o_custkey, o_orderpriority, c_name, c_nationkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def merge_by_content(spark, sf_dir):
    """Extension: four tables that share no column's name, joined by what their columns hold."""
    tables = [read(spark, sf_dir, t) for t in ("orders", "region", "nation", "customer")]
    out = discover.merge_by_content(tables)
    return out.select("o_orderkey", "o_custkey", "o_orderpriority", "c_name", "c_nationkey", "n_name", "r_name")
