"""The registered queries over the driver's tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import cells
from lodeflow.functions.display import action_of, either, thousands
from lodeflow.operators import catalog, chart, clean, merge, validate
from lodeflow.operators.contracts import contract_table
from lodeflow.sources import names, store
from lodeflow.sources.shared import shared_path
from lodeflow.streaming.incremental import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The same white space for DuckDB's regular expressions.
_WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _sql_number(x: str) -> str:
    t = _sql_trim(x)
    decimal = r"[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {t} = '' THEN 0.0 WHEN regexp_full_match({t}, '{decimal}') THEN try_cast({t} AS DOUBLE) ELSE 'NaN'::DOUBLE END"


def _sql_title(x: str) -> str:
    lead = "regexp_extract(t, '^[^A-Za-z0-9_]*')"
    one = f"{lead} || upper(substr(t, len({lead}) + 1, 1)) || lower(substr(t, len({lead}) + 2))"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[{_WS}]+|[^{_WS}]+'), lambda t: {one}), '')"


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


@query("SELECT l_returnflag AS label, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def chart_sum_by_flag(spark, sf_dir):
    return rounded(chart.group_sum(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), "total")


@query("SELECT CAST(o_custkey AS VARCHAR) AS label, round(t, 2) AS total FROM (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)")
def chart_sum_top20_customers(spark, sf_dir):
    return rounded(chart.group_sum(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice"), "total")


@query("SELECT event_type AS label, round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 2) AS total FROM events GROUP BY 1")
def chart_null_measure_as_zero(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(chart.group_sum(rows, "event_type", "value"), "total")


@query("""WITH t AS (SELECT l_shipmode_, l_linestatus, CASE l_returnflag WHEN 'A' THEN ' ' || CAST(l_quantity AS VARCHAR) || ' ' WHEN 'N' THEN CAST(l_quantity AS VARCHAR) || 'd' ELSE '' END AS m
  FROM (SELECT *, l_linenumber AS l_shipmode_ FROM lineitem))
SELECT CAST(l_shipmode_ AS VARCHAR) AS label, round(sum(v), 2) AS total FROM (SELECT l_shipmode_, CASE WHEN trim(m) = '' THEN 0.0 WHEN m LIKE '%d' THEN NULL ELSE CAST(trim(m) AS DOUBLE) END AS v FROM t) WHERE v IS NOT NULL GROUP BY 1""")
def chart_text_measure(spark, sf_dir):
    """Text measures: padded numbers count, numbers with a letter drop their rows, empty text counts 0."""
    text = F.col("l_quantity").cast("string")
    measure = F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), text, F.lit(" "))).when(F.col("l_returnflag") == "N", F.concat(text, F.lit("d"))).otherwise("")
    return rounded(chart.group_sum(read(spark, sf_dir, "lineitem").withColumn("m", measure), "l_linenumber", "m"), "total")


def _merge(how: str):
    def run(spark, sf_dir):
        docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
        labels = read(spark, sf_dir, "labels").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1_000_000_000))
        return merge.merge(docs, labels, how)

    run.__name__ = f"merge_{how}"
    kind = {"outer": "FULL", "right": "RIGHT", "left": "LEFT", "inner": "INNER"}[how]
    return query(f"""WITH b AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS doc_id, quality, toxic FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, lang, source, n_chars, quality, toxic FROM documents a {kind} JOIN b ON a.doc_id = b.doc_id""")(run)


for _how in merge.JOINS:
    _merge(_how)


@query("""WITH a AS (SELECT nullif(c_nationkey, 3) AS k, c_custkey, c_mktsegment FROM customer), b AS (SELECT nullif(n_nationkey, 7) AS k, n_name FROM nation)
SELECT coalesce(a.k, b.k) AS k, c_custkey, c_mktsegment, n_name FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def merge_null_keys(spark, sf_dir):
    """Null keys on both sides match each other."""
    a = read(spark, sf_dir, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_custkey", "c_mktsegment")
    b = read(spark, sf_dir, "nation").select(F.nullif("n_nationkey", F.lit(7)).alias("k"), "n_name")
    return merge.merge(a, b, "outer")


_SIDES = """WITH a AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS k, o_orderkey, o_orderpriority AS note FROM orders), b AS (SELECT c_custkey AS k, c_mktsegment AS note FROM customer)
"""


def _sides(spark, sf_dir):
    k = F.col("o_custkey")
    a = read(spark, sf_dir, "orders").select(F.when(k % 3 == 0, k + 1_000_000_000).otherwise(k).alias("k"), "o_orderkey", F.col("o_orderpriority").alias("note"))
    return a, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("note"))


@query(_SIDES + "SELECT coalesce(a.k, b.k) AS k, o_orderkey, a.note, b.note AS note_b FROM a FULL JOIN b ON a.k = b.k")
def merge_collision(spark, sf_dir):
    return merge.merge(*_sides(spark, sf_dir), "outer")


@query(_SIDES + "SELECT coalesce(a.k, b.k) AS k, o_orderkey, CASE WHEN a.k IS NULL THEN b.note ELSE a.note END AS note, CASE WHEN a.k IS NOT NULL THEN b.note END AS note_b FROM a FULL JOIN b ON a.k = b.k")
def merge_collision_left_slot(spark, sf_dir):
    return merge.merge(*_sides(spark, sf_dir), "outer", right_collision="left_slot")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name, NULL::VARCHAR AS other FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), NULL, n_name FROM nation")
def merge_type_strict(spark, sf_dir):
    """A number never equals its own text."""
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    b = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("other"))
    return merge.merge(a, b, "outer")


@query("""SELECT coalesce(l.region_key, r.region_key) AS region_key, n_nationkey, n_name, r_name, s_suppkey FROM (SELECT n_regionkey AS region_key, n_nationkey, n_name FROM nation) l
JOIN (SELECT r_regionkey AS region_key, r_name FROM region) r ON l.region_key = r.region_key JOIN (SELECT s_nationkey AS n_nationkey, s_suppkey FROM supplier) s USING (n_nationkey)""")
def merge_all_shared(spark, sf_dir):
    """Extension: three datasets folded on what they share."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region_key"), "n_nationkey", "n_name")
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_key"), "r_name")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return merge.merge_all([nation, region, supplier])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def clean_trim(spark, sf_dir):
    """Names padded with a tab, a no-break space and a line feed come back as they were."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("\t "), F.col("c_name"), F.lit(" ﻿\n")).alias("c_name"), "c_mktsegment")
    return clean.clean(rows, ["trim"])


@query("SELECT p_partkey, " + ", ".join(f"{_sql_title(c)} AS {n}" for c, n in (("p_name", "p_name"), ("'(' || p_type", "p_type"), ("upper(p_name) || '  o''NEIL'", "p_brand"))) + " FROM part")
def clean_title_case(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("("), F.col("p_type")).alias("p_type"), F.concat(F.upper("p_name"), F.lit("  o'NEIL")).alias("p_brand"))
    return clean.clean(rows, ["normalize_case"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'NaN'::DOUBLE ELSE round(o_totalprice, 2) END AS often, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS rarely FROM orders")
def clean_fix_numeric(spark, sf_dir):
    """Nine tenths numbers: the rest becomes NaN. Exactly four fifths: text stays."""
    rows = read(spark, sf_dir, "orders")
    often = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.round("o_totalprice", 2).cast("string"))
    rarely = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    return clean.clean(rows.select("o_orderkey", often.alias("often"), rarely.alias("rarely")), ["fix_types"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'later' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def clean_fix_date(spark, sf_dir):
    """Dates in several spellings become yyyy-MM-dd; what is none stays."""
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 10
    text = F.when(k == 0, "later").when(k == 1, F.date_format(day, "yyyy/M/d")).when(k == 2, F.date_format(day, "M/d/yyyy")).when(k == 3, F.date_format(day, "d MMM yyyy")).when(k == 4, F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return clean.clean(read(spark, sf_dir, "orders").select("o_orderkey", text.alias("day")), ["fix_types"])


@query("SELECT DISTINCT text, lang, source, n_chars FROM documents")
def clean_dedupe(spark, sf_dir):
    return clean.clean(read(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars"), ["dedupe"])


@query("SELECT DISTINCT CASE WHEN l_linenumber > 3 THEN NULL ELSE l_quantity END AS q, l_returnflag FROM lineitem")
def clean_dedupe_numbers(spark, sf_dir):
    """NaN, infinity and null are the same for finding duplicates; the null comes first here, so it stays."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = read(spark, sf_dir, "lineitem").select(F.when(n == 4, float("nan")).when(n == 5, float("inf")).when(n > 5, None).otherwise(q).alias("q"), "l_returnflag")
    return clean.clean(rows, ["dedupe"]).withColumn("q", F.when(~(F.isnan("q") | (F.abs("q") == float("inf"))), F.col("q")))


@query("SELECT p_partkey, CASE WHEN p_size = 5 THEN 'NaN'::DOUBLE WHEN p_size % 2 = 0 THEN 0 ELSE p_retailprice END AS price, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS size FROM part")
def clean_fill(spark, sf_dir):
    s = F.col("p_size")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(s == 5, float("nan")).when(s % 2 != 0, F.col("p_retailprice")).alias("price"), F.when(s % 3 != 0, F.col("p_brand")).alias("brand"), F.when(s % 7 != 0, s).alias("size"))
    return clean.clean(rows, ["fill_missing"])


@query("""SELECT DISTINCT """ + _sql_title("c_mktsegment") + """ AS segment, CAST(c_nationkey AS DOUBLE) AS nation, '' AS gap FROM customer""")
def clean_pipeline(spark, sf_dir):
    """All operations, listed in another order than they run in."""
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("\t")).alias("segment"), F.concat(F.col("c_nationkey").cast("string"), F.lit(" ")).alias("nation"), F.lit(None).cast("string").alias("gap"))
    return clean.clean(rows, ["fill_missing", "dedupe", "fix_types", "normalize_case", "trim"])


_HEADERS = ("invoice_date,region,amount", "invoice_date,region", "invoice_date,region,amount,region", " invoice_date ,region,amount", "  ")


@query(f"""WITH f AS (SELECT 'nation ' || c_nationkey AS file, {list(_HEADERS)!r}[c_nationkey % 5 + 1] AS header, CASE WHEN c_nationkey % 5 < 3 THEN count(*) ELSE 0 END AS n FROM customer GROUP BY c_nationkey),
h AS (SELECT file, n, list_transform(string_split(header, ','), lambda x: trim(x)) AS hs, trim(header) = '' AS blank FROM f),
c AS (SELECT file, blank, n, list_filter(['invoice_date', 'region', 'amount'], lambda r: NOT list_contains(hs, r)) AS missing, len(hs) - len(list_distinct(hs)) AS twice FROM h)
SELECT file, 'File is empty.' AS message, false AS ok FROM c WHERE blank
UNION ALL SELECT file, CASE WHEN twice = 0 THEN 'No duplicate columns.' ELSE 'Duplicate column(s): region' END, twice = 0 FROM c WHERE NOT blank
UNION ALL SELECT file, CASE WHEN len(missing) = 0 THEN 'All required columns present (invoice_date, region, amount).' ELSE 'Missing required column(s): ' || array_to_string(missing, ', ') END, len(missing) = 0 FROM c WHERE NOT blank
UNION ALL SELECT file, CASE WHEN n > 0 THEN n || ' data row(s) found.' ELSE 'File has a header but no data rows.' END, n > 0 FROM c WHERE NOT blank""")
def validate_contract(spark, sf_dir):
    """A file for each nation, with its customers as data lines and one of several headers."""
    k = F.col("c_nationkey")
    header = F.get(F.array(*map(F.lit, _HEADERS)), k % 5)
    files = read(spark, sf_dir, "customer").groupBy(k).agg(F.count("*").alias("n"))
    files = files.select(F.concat(F.lit("nation "), k.cast("string")).alias("file"), header.alias("header"), F.when(k % 5 < 3, F.col("n")).otherwise(0).alias("n"))
    need = contract_table(spark).where("type_id = 'invoice_summary'").select("required_columns").first()[0]
    found = validate.checks(F.col("header"), F.col("n"), F.array(*map(F.lit, need)))
    return files.select("file", F.explode(found).alias("c")).select("file", "c.message", "c.ok")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') OR contains(lower(p_brand), 'an')
UNION ALL SELECT -p_partkey, p_name || '%' FROM part WHERE p_partkey % 50 = 0""")
def catalog_search(spark, sf_dir):
    """A plain term, then a literal percent sign, which is no wildcard."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("display_name"), F.col("p_brand").alias("division"))
    marked = rows.withColumn("name", F.when(F.col("p_partkey") % 50 == 0, F.concat("name", F.lit("%"))).otherwise(F.col("name"))).withColumn("p_partkey", -F.col("p_partkey"))
    return catalog.search(rows, " AN ").union(catalog.search(marked, "%")).select("p_partkey", F.col("name").alias("p_name"))


@query("""WITH m(nk, display_name, owner, override_) AS (VALUES (1, '', 'Ann', 'Finance'), (2, 'Two', '', ''), (3, NULL, NULL, NULL))
SELECT n_nationkey, coalesce(nullif(display_name, ''), n_name) AS display_name, coalesce(nullif(owner, ''), 'Workspace') AS owner, coalesce(nullif(override_, ''), CASE WHEN n_regionkey = 1 THEN 'Finance' WHEN n_regionkey = 2 THEN 'other' ELSE 'General' END) AS division
FROM nation LEFT JOIN m ON n_nationkey = nk""")
def catalog_defaults(spark, sf_dir):
    meta = spark.createDataFrame([(1, "", "Ann", "Finance"), (2, "Two", "", ""), (3, None, None, None)], "nk int, display_name string, owner string, override_ string")
    rows = read(spark, sf_dir, "nation").withColumn("division_id", F.when(F.col("n_regionkey") == 1, "finance").when(F.col("n_regionkey") == 2, "other"))
    labels = contract_table(spark).select(F.col("division_id").alias("di"), "division_label").distinct()
    rows = rows.join(F.broadcast(meta), F.col("n_nationkey") == F.col("nk"), "left").join(F.broadcast(labels), F.col("division_id") == F.col("di"), "left")
    return rows.select("n_nationkey", either(F.col("display_name"), names.last_segment(F.concat(F.lit("a__b__"), F.col("n_name")))).alias("display_name"), either(F.col("owner"), F.lit("Workspace")).alias("owner"), either(F.col("override_"), F.col("division_label"), F.col("division_id"), F.lit("General")).alias("division"))


@query("SELECT lang AS division, round(mb, 6) AS mb, round(mb / greatest(max(mb) OVER (), 1) * 100, 6) AS pct FROM (SELECT lang, sum(n_chars) / 1024 / 1024 AS mb FROM documents WHERE source <> 'src0' GROUP BY lang)")
def stats_storage(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").withColumn("layer", F.when(F.col("source") == "src0", "Silver").otherwise("Bronze"))
    out = catalog.storage_by_division(rows, size="n_chars", by="lang")
    return out.select("division", F.round("mb", 6).alias("mb"), F.round("pct", 6).alias("pct"))


@query("SELECT count(*) AS total_datasets, round(sum(n_chars) / 1024 / 1024, 6) AS storage_used_mb, count(*) AS total_files, 0 AS active_jobs, 2 AS user_count FROM documents")
def stats_totals(spark, sf_dir):
    return catalog.totals(read(spark, sf_dir, "documents").withColumnRenamed("n_chars", "_size_bytes")).withColumn("storage_used_mb", F.round("storage_used_mb", 6))


@query("""SELECT CAST(event_id AS VARCHAR) AS dataset, CASE event_type WHEN 'click' THEN 'was uploaded' WHEN 'view' THEN 'was cleaned in Prepare' WHEN 'signup' THEN 'was created in Merge' ELSE 'was updated' END AS action,
CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END END AS time_ago
FROM (SELECT *, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) AS BIGINT) AS s FROM events ORDER BY ts DESC, event_id LIMIT 6)""")
def stats_recent(spark, sf_dir):
    layer = F.when(F.col("event_type") == "click", "Bronze").when(F.col("event_type") == "view", "Silver").when(F.col("event_type") == "signup", "Gold").otherwise("?")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("display_name"), "event_id", layer.alias("layer"), F.col("ts").alias("_last_modified_raw"))
    return catalog.recent_activity(rows, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), tie="event_id")


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'dataset') AS stub, regexp_replace(url, '(?i)\.html$', '') AS stem, 'x' || page_id AS last FROM pages")
def names_sanitize(spark, sf_dir):
    rows = read(spark, sf_dir, "pages")
    stem = names.without_csv(F.regexp_replace("url", r"(?i)\.html\z", ".CSV"))
    return rows.select("page_id", names.sanitize(F.col("url")).alias("stub"), stem.alias("stem"), names.last_segment(F.concat(F.lit("a__b__x"), F.col("page_id").cast("string"))).alias("last"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(CAST(nullif(o_custkey % 4, 0) AS VARCHAR), '') AS part, o_orderstatus FROM orders ORDER BY orders.o_orderkey LIMIT 15")
def preview_first15(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("part"), "o_orderstatus")
    return merge.preview(rows, ["o_orderkey"])


@query("SELECT o_orderkey, " + _sql_number("t") + " AS number FROM (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN ' ' WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN ' -' || o_custkey || '.5e1 ' WHEN 3 THEN o_custkey || 'f' WHEN 4 THEN 'Infinity' WHEN 5 THEN 'inf' WHEN 6 THEN NULL ELSE '1_' || o_custkey END AS t FROM orders)")
def text_numbers(spark, sf_dir):
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    t = F.when(k == 0, " ").when(k == 1, c).when(k == 2, F.concat(F.lit(" -"), c, F.lit(".5e1 "))).when(k == 3, F.concat(c, F.lit("f"))).when(k == 4, "Infinity").when(k == 5, "inf").when(k == 6, None).otherwise(F.concat(F.lit("1_"), c))
    return read(spark, sf_dir, "orders").select("o_orderkey", cells.text_number(t).alias("number"))


@query("SELECT date_trunc('day', ts) AS begins, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    """Extension: the streaming count by key and day, over the table as a batch."""
    ts = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(ts, "ts", "event_type")
    return out.withColumn("begins", F.col("begins").cast("timestamp_ntz"))


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' AS dataset, true AS has_bytes")
def file_listing(spark, sf_dir):
    """The tables' own files: a table is a file or a folder of parts."""
    table = F.regexp_extract("path", r"/([^/]+\.parquet)(/[^/]*)?\z", 1)
    return store.listing(spark, sf_dir).groupBy(table.alias("dataset")).agg((F.sum("length") > 0).alias("has_bytes"))


@query("""SELECT event_type, CASE event_type WHEN 'click' THEN 'was uploaded' WHEN 'view' THEN 'was cleaned in Prepare' WHEN 'signup' THEN 'was created in Merge' ELSE 'was updated' END AS action, count(*) AS n FROM events GROUP BY 1""")
def activity_words(spark, sf_dir):
    layer = F.when(F.col("event_type") == "click", "Bronze").when(F.col("event_type") == "view", "Silver").when(F.col("event_type") == "signup", "Gold").otherwise("x")
    return read(spark, sf_dir, "events").groupBy("event_type", action_of(layer).alias("action")).agg(F.count("*").alias("n"))


@query("SELECT least(count(*), 15) AS shown, count(*) AS total, format('{:,}', count(*)) AS title FROM orders")
def preview_counts(spark, sf_dir):
    return merge.preview_counts(read(spark, sf_dir, "orders")).withColumn("title", thousands(F.col("total")))


@query("""SELECT CAST(l.k AS VARCHAR) AS k, CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM (SELECT o_custkey AS k, o_orderkey FROM orders) l
LEFT JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000000 END AS k, c_mktsegment FROM customer) r ON l.k = r.k ORDER BY l.k, l.o_orderkey LIMIT 15""")
def merge_preview(spark, sf_dir):
    left = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    right = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1_000_000_000).alias("k"), "c_mktsegment")
    return merge.preview(merge.merge(left, right, "left"), ["k", "o_orderkey"])


@query("SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS measure")
def chart_measures(spark, sf_dir):
    found = chart.numeric_columns(read(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c,) for c in found], "measure string")


@query("SELECT 'price' AS name, count(*) AS cells, count(*) AS numbers, 0 AS dates FROM orders UNION ALL SELECT 'day', count(*), 0, count(*) FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'status', count(*), 0, 0 FROM orders")
def clean_votes(spark, sf_dir):
    """What fix_types counts for each text column: cells, numbers, dates."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("string").alias("price"), F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.col("o_orderstatus").alias("status"))
    found = clean.profile(rows)
    return spark.createDataFrame([(c, *v) for c, v in found.items()], "name string, cells long, numbers long, dates long")


@query("SELECT DISTINCT c_mktsegment AS division FROM customer")
def catalog_divisions(spark, sf_dir):
    return catalog.divisions(read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "division"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1")
def clean_keep_last(spark, sf_dir):
    """Extension: of each nation's customers the last one stays."""
    return clean.dedupe(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "last", ["c_nationkey"], "c_custkey")


#: A column as a CSV file may have it: numbers in two spellings, texts, empty cells.
_MIXED_SQL = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_custkey || '.0' WHEN 2 THEN 'c' || o_custkey ELSE '' END"


def _mixed():
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    return F.when(k == 0, c).when(k == 1, F.concat(c, F.lit(".0"))).when(k == 2, F.concat(F.lit("c"), c)).otherwise("")


@query(f"SELECT o_orderkey, coalesce(nullif({_MIXED_SQL}, ''), '0') AS mixed, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS plain FROM orders")
def clean_fill_mixed(spark, sf_dir):
    """A text column with some number is numeric: its empty cells become 0; one without becomes empty text."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", _mixed().alias("mixed"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("plain"))
    return clean.clean(rows, ["fill_missing"], cells=True)


@query(f"SELECT DISTINCT CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE nullif({_MIXED_SQL}, '') END AS cell, o_orderstatus FROM orders")
def clean_dedupe_mixed(spark, sf_dir):
    """1 and 1.0 are one number; which of the spellings stays is not compared."""
    out = clean.clean(read(spark, sf_dir, "orders").select(_mixed().alias("cell"), "o_orderstatus"), ["dedupe"], cells=True)
    return out.withColumn("cell", F.nullif(F.regexp_replace("cell", r"\.0\z", ""), F.lit("")))


@query(f"""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE nullif({_MIXED_SQL}, '') END AS k FROM orders),
b AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name FROM customer)
SELECT o_orderkey, a.k, c_name FROM a LEFT JOIN b ON a.k = b.k""")
def merge_mixed_kinds(spark, sf_dir):
    """Number cells of a mixed column match a numeric key, whatever their spelling; its texts match nothing there."""
    a = read(spark, sf_dir, "orders").select("o_orderkey", _mixed().alias("k"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    out = merge.merge(a, b, "left", on="k", cells=True)
    return out.withColumn("k", F.nullif(F.regexp_replace("k", r"\.0\z", ""), F.lit("")))


@query("SELECT unnest(['o_orderkey', 'mixed']) AS measure")
def chart_measures_mixed(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", _mixed().alias("mixed"), "o_orderstatus")
    return spark.createDataFrame([(c,) for c in chart.numeric_columns(rows, cells=True)], "measure string")


def fresh_lake(spark) -> str:
    """A new lake's root in the folder that driver and executors share; it goes when the driver's JVM ends."""
    return shared_path(spark, "lake")


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'a \"b\", c' ELSE ' d ' END AS note FROM customer")
def csv_round_trip(spark, sf_dir):
    """Written as a cleaned dataset, read by layer and name: quotes, commas and spaces stay, nulls are nothing."""
    root, k = fresh_lake(spark), F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(k % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 2 == 0, 'a "b", c').otherwise(" d ").alias("note"))
    name = store.write_silver(rows, root, "customers")
    return store.read_dataset(spark, root, "Silver", name)


@query("SELECT 'Silver' AS layer, 'orders_cleaned' AS name, count(*) AS rows, 3 AS columns, 'Active' AS status FROM orders UNION ALL SELECT 'Silver', 'none_cleaned', 0, 2, 'Error'")
def catalog_counts(spark, sf_dir):
    """The catalog of a lake with a dataset of all orders and one that has a header only."""
    root = fresh_lake(spark)
    store.write_silver(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), root, "orders")
    store.put_text(spark, names.path_of(root, "Silver", "none_cleaned"), "a,b\n")
    return catalog.catalog(spark, root).select("layer", "name", "rows", "columns", "status")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def download_csv(spark, sf_dir):
    """A cleaned dataset in several parts, downloaded as one text with one header."""
    root = fresh_lake(spark)
    name = store.write_silver(read(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(3), root, "nation")
    path = store.download(spark, root, "Silver", name, f"{root}/out")
    return store.read_csv(spark, path, typed=False)
