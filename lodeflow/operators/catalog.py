"""The catalog of datasets, its filters, and the dashboard's statistics."""

from __future__ import annotations

import uuid
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeflow.functions.display import action_of, either, megabytes, shown_date, time_ago
from lodeflow.operators.contracts import division_labels
from lodeflow.sources import names, store, versions
from lodeflow.sources.records import file_counts

#: Where a lake keeps its files' counts; files counted in one job; folders of counts before they are put into one.
COUNTS, CHUNK, FOLDERS = "counts_v3", 5000, 40
COUNTS_SCHEMA = "path string, modified timestamp, length bigint, rows bigint, columns int"


def _dataset(path: Column, root: str) -> Column:
    """(layer, name, division_id, version) of a file below root; null for files that belong to no dataset.

    Bronze: <division>/<type>/<stub>.csv. Silver and Gold: <name>/data.csv or data.parquet, a file or a folder of parts;
    versions of a Silver dataset lie in a folder beside that.
    """
    plain = lambda c: F.regexp_replace(c, r"\A[a-z0-9]+:/*", "/")
    base = F.concat(F.lit(r"\A\Q"), plain(F.lit(root.rstrip("/"))), F.lit(r"\E/"))
    rel = F.regexp_replace(plain(F.url_decode(F.regexp_replace(path, r"\+", "%2B"))), base, F.lit(""))
    parts = F.split(rel, "/")
    bronze = rel.startswith(f"{names.PREFIXES['Bronze']}/") & rel.endswith(".csv") & (F.size(parts) == 4)
    stub = F.regexp_replace(F.get(parts, F.lit(3)), r"\.csv\z", "")
    division = F.get(parts, F.lit(1))
    none = F.lit(None).cast("string")
    out = F.when(bronze, F.struct(F.lit("Bronze").alias("layer"), F.concat_ws("__", division, F.get(parts, F.lit(2)), stub).alias("name"), division.alias("division_id"), none.alias("version")))
    version = rf"\A{names.PREFIXES['Silver']}/(.+)/{names.VERSIONS}/([0-9a-f]{{32}})/data\.csv/part-[^/]*\z"
    out = out.when(rel.rlike(version), F.struct(F.lit("Silver").alias("layer"), F.regexp_extract(rel, version, 1).alias("name"), none.alias("division_id"), F.regexp_extract(rel, version, 2).alias("version")))
    for layer in ("Silver", "Gold"):
        pattern = rf"\A{names.PREFIXES[layer]}/(.+)/data\.(csv|parquet)(/part-[^/]*)?\z"
        out = out.when(rel.rlike(pattern), F.struct(F.lit(layer).alias("layer"), F.regexp_extract(rel, pattern, 1).alias("name"), none.alias("division_id"), none.alias("version")))
    return out


def visible(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The listed files that belong to datasets as they are now: of one with versions, those of the current one only."""
    known = files.withColumn("d", _dataset(F.col("path"), root)).where("d is not null")
    now = versions.current(spark, root).select(F.col("layer").alias("vl"), F.col("name").alias("vn"), "folder")
    own = known.join(now, (F.col("d.layer") == F.col("vl")) & (F.col("d.name") == F.col("vn")), "left")
    return own.where(F.col("d.version").eqNullSafe(F.col("folder"))).select(*files.columns)


def entries(files: DataFrame, root: str) -> DataFrame:
    """(layer, name, division_id, last_modified, size_bytes) of the datasets among listed files."""
    known = files.withColumn("d", _dataset(F.col("path"), root)).where("d is not null").select("d.*", "modificationTime", "length")
    return known.groupBy("layer", "name", "division_id").agg(F.max("modificationTime").alias("last_modified"), F.sum("length").alias("size_bytes"))


def enrich(found: DataFrame, metadata: DataFrame, counts: DataFrame, labels: DataFrame, include_archived: bool = False) -> DataFrame:
    """The twelve fields of a catalog entry. counts: (layer, name, rows, columns); datasets without one have 0 rows."""
    m = metadata.select(F.col("layer").alias("ml"), F.col("name").alias("mn"), "display_name", "owner", "division_override", "archived")
    c = counts.select(F.col("layer").alias("cl"), F.col("name").alias("cn"), "rows", "columns")
    out = found.join(m, (F.col("layer") == F.col("ml")) & (F.col("name") == F.col("mn")), "left").join(c, (F.col("layer") == F.col("cl")) & (F.col("name") == F.col("cn")), "left")
    out = out.join(F.broadcast(labels.withColumnRenamed("division_id", "di")), F.col("division_id") == F.col("di"), "left")
    archived = F.coalesce("archived", F.lit(False))
    if not include_archived:
        out = out.where(~archived)
    rows = F.coalesce("rows", F.lit(0)).cast("long")
    return out.select(
        "layer",
        "name",
        either(F.col("display_name"), names.last_segment(F.col("name"))).alias("display_name"),
        either(F.col("division_override"), F.col("division_label"), F.col("division_id"), F.lit("General")).alias("division"),
        either(F.col("owner"), F.lit("Workspace")).alias("owner"),
        rows.alias("rows"),
        F.coalesce("columns", F.lit(0)).cast("int").alias("columns"),
        F.when(rows > 0, "Active").otherwise("Error").alias("status"),
        shown_date(F.col("last_modified")).alias("last_updated"),
        F.col("last_modified").alias("_last_modified_raw"),
        F.col("size_bytes").alias("_size_bytes"),
        archived.alias("archived"),
    )


def row_counts(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(layer, name, rows, columns) of the datasets. Counts of files are kept in the lake; only new and changed ones are read.

    CSV records are counted in blocks, the header of each file left out; columns are those of the header. Parquet files of
    the Gold layer are counted by their footers.
    """
    dataset = _dataset(F.col("path"), root)
    known = files.where(dataset.isNotNull() & (F.col("length") > 0)).select("path", F.col("modificationTime").alias("modified"), "length")
    counts = KeptCounts(spark, f"{root.rstrip('/')}/{COUNTS}")
    counts.follow(known)
    own = known.join(counts.read(), ["path", "modified", "length"])
    return own.groupBy(dataset.alias("d")).agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns")).select("d.layer", "d.name", "rows", "columns")


class KeptCounts:
    """Rows and columns of files, by path, time of change and length, in a folder of their own below the lake's root.

    Each reader adds what it had to count as a folder of its own, so several can at once; many folders are put into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folders(self) -> list[str]:
        fs, p = store.file_system(self.spark, self.path)
        if not fs.exists(p):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(p)]
        return [f for f in found if fs.exists(store.file_system(self.spark, f"{f}/_SUCCESS")[1])]

    def read(self) -> DataFrame:
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], COUNTS_SCHEMA)
        return self.spark.read.schema(COUNTS_SCHEMA).parquet(*folders).groupBy("path", "modified", "length").agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"))

    def _add(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def follow(self, files: DataFrame) -> int:
        """Count what is new among files (path, modified, length); how many files were read. CHUNK files are taken at once."""
        changed = files.join(self.read(), ["path", "modified", "length"], "left_anti")
        done, rows = 0, changed.toLocalIterator()
        while chunk := list(islice(rows, CHUNK)):
            done += len(chunk)
            listed = self.spark.createDataFrame(chunk, files.schema)
            counted = [_csv_counts(self.spark, [r["path"] for r in chunk if "/data.parquet" not in r["path"]]), _parquet_counts(self.spark, [r["path"] for r in chunk if "/data.parquet" in r["path"]])]
            self._add(listed.join(store.union_all(counted), "path").select(*files.columns, "rows", "columns"))
        if len(folders := self._folders()) > FOLDERS:
            self._add(self.read().join(files, ["path", "modified", "length"], "left_semi"))
            for f in folders:
                fs, p = store.file_system(self.spark, f)
                fs.delete(p, True)
        return done


def _csv_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "path string, rows long, columns int")
    width = F.size(F.split("header", r',(?=(?:[^"]*"[^"]*")*[^"]*\z)', -1))
    return file_counts(spark, paths).select("path", "rows", width.alias("columns"))


def _parquet_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of each file; columns by one footer of each table."""
    if not paths:
        return spark.createDataFrame([], "path string, rows long, columns int")
    at = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"\A([a-z0-9]+):/+", "$1:/")
    rows = spark.read.schema("none_ string").parquet(*paths).select(at.alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    firsts = {p.rsplit("/", 1)[0]: p for p in paths}
    widths = spark.createDataFrame([(t, len(spark.read.parquet(p).columns)) for t, p in firsts.items()], "t string, columns int")
    named = spark.createDataFrame([(p, p.rsplit("/", 1)[0]) for p in paths], "path string, t string").join(F.broadcast(widths), "t")
    plain = named.withColumn("p", F.regexp_replace("path", r"\A([a-z0-9]+):/+", "$1:/"))
    return plain.join(rows.withColumnRenamed("path", "q"), F.col("p") == F.col("q"), "left").select("path", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "columns")


def catalog(spark: SparkSession, root: str, include_archived: bool = False) -> DataFrame:
    files = visible(spark, root, store.listing(spark, root))
    return enrich(entries(files, root), store.metadata_table(spark, root), row_counts(spark, root, files), division_labels(spark), include_archived)


class KeptCatalog:
    """A catalog that is read once and reused until dropped, as after a clean or an upload; an empty one is read again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.kept = spark, root, None

    def get(self) -> DataFrame:
        if self.kept is None or self.kept.isEmpty():
            self.drop()
            self.kept = catalog(self.spark, self.root).persist()
            self.kept.count()  # all of it, as the files are now
        return self.kept

    def drop(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
        self.kept = None


def search(df: DataFrame, term: str = "", layer: str = "", division: str = "") -> DataFrame:
    """Substring of name, display name or division, without regard to case; equal layer and division; empty passes all."""
    wanted = F.lower(F.lit(term.strip()))
    hit = F.lower("name").contains(wanted) | F.lower("display_name").contains(wanted) | F.lower("division").contains(wanted)
    out = df.where(hit) if term.strip() else df
    out = out.where(F.col("layer") == layer) if layer else out
    return out.where(F.col("division") == division) if division else out


def divisions(df: DataFrame) -> DataFrame:
    return df.select("division").distinct().orderBy("division")


def totals(df: DataFrame) -> DataFrame:
    """One row: datasets, files, storage; jobs and users are the constants that the dashboard shows."""
    n = F.count("*")
    return df.agg(n.alias("total_datasets"), F.coalesce(F.sum(megabytes(F.col("_size_bytes"))), F.lit(0.0)).alias("storage_used_mb"), n.alias("total_files"), F.lit(0).alias("active_jobs"), F.lit(2).alias("user_count"))


def storage_by_division(df: DataFrame, layer: str = "Bronze", size: str = "_size_bytes", by: str = "division") -> DataFrame:
    """(division, mb, pct): pct is the bar's width, against the largest, at least 1 MB."""
    sums = df.where(F.col("layer") == layer).groupBy(F.col(by).alias("division")).agg(F.sum(megabytes(F.col(size))).alias("mb"))
    most = F.max("mb").over(Window.partitionBy())
    return sums.withColumn("pct", F.col("mb") / F.greatest(most, F.lit(1.0)) * 100).orderBy(F.desc("mb"), "division")


def recent_activity(df: DataFrame, now: Column, n: int = 6, tie: str = "name") -> DataFrame:
    """(dataset, action, time_ago) of the latest datasets."""
    rows = df.where(F.col("_last_modified_raw").isNotNull()).orderBy(F.desc("_last_modified_raw"), tie).limit(n)
    return rows.select(F.col("display_name").alias("dataset"), action_of(F.col("layer")).alias("action"), time_ago(F.col("_last_modified_raw"), now).alias("time_ago"))
