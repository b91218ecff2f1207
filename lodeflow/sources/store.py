"""Reading and writing the layered store, on any file system that Spark reaches.

Object stores are reached by their Hadoop connectors; credentials come from the session's configuration or environment.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeflow.functions.cells import text_kind
from lodeflow.sources import names
from lodeflow.sources.records import ROW, digests, records

CSV_READ = {"header": True, "multiLine": True, "escape": '"', "inferSchema": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_WRITE = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
METADATA_FIELDS = ("display_name", "owner", "division_override", "archived")
METADATA_SCHEMA = "display_name string, owner string, division_override string, archived boolean"


def object_store(endpoint: str, path_style: bool = True) -> dict[str, str]:
    """Session settings for an S3-compatible store. Keys come from the environment, never from code."""
    return {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(), "spark.hadoop.fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.EnvironmentVariableCredentialsProvider"}


def file_system(spark: SparkSession, path: str):
    """A path's Hadoop file system, and the path as that names it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def reachable(spark: SparkSession, root: str) -> bool:
    """Whether the root answers; any failure counts as no."""
    try:
        fs, p = file_system(spark, root)
        return bool(fs.exists(p))
    except Exception:  # noqa: BLE001 - the answer to a connection test
        return False


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files below; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Byte for byte."""
    a, p = file_system(spark, source)
    b, q = file_system(spark, target)
    b.mkdirs(q.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration())


def same_bytes(spark: SparkSession, first: str, second: str) -> DataFrame:
    """One row, same: whether two files hold the same bytes. Files of equal length are cut into the same blocks in one scan;
    those are compared by digests."""
    length = [fs.getFileStatus(p).getLen() for fs, p in (file_system(spark, path) for path in (first, second))]
    if length[0] != length[1] or first == second or not length[0]:
        return spark.createDataFrame([(length[0] == length[1],)], "same boolean")
    pairs = digests(spark, [first, second]).groupBy("block").agg(((F.count("*") == 2) & (F.min("digest") == F.max("digest"))).alias("same"))
    return pairs.agg(F.coalesce(F.bool_and("same"), F.lit(False)).alias("same"))


def read_csv(spark: SparkSession, path: str, typed: bool = True, ordered: bool = False) -> DataFrame:
    """A CSV dataset. Typed: a column whose cells are all numbers (or all booleans, or date-times) gets that type.

    That decision needs one pass over the data, as a single aggregate over all columns. Files are read in blocks by many
    tasks. Ordered: a column ROW has each row's place.
    """
    df = spark.read.options(**CSV_READ).csv(path)  # only its header is read
    found = df.columns
    if found or ordered:
        schema = ", ".join(f"c{i} string" for i in range(len(found)))
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_READ.items() if k != "header"}
        df = records(spark, path).select(ROW, F.from_csv("record", schema, options).alias("r")).select(ROW, "r.*").toDF(ROW, *found)
        df = df if ordered else df.drop(ROW)
    return typed_cells(df) if typed else df


def typed_cells(df: DataFrame) -> DataFrame:
    cols = [c for c in df.columns if c != ROW]
    if not cols:
        return df
    place = [ROW] if ROW in df.columns else []
    plain = df.select(*place, *[df[c] for c in df.columns if c != ROW]) if place else df
    plain = plain.toDF(*place, *[f"c{i}" for i in range(len(cols))])
    kinds = {"number": "double", "boolean": "boolean", "datetime": "timestamp"}
    tests = [F.count_if(text_kind(F.col(f"c{i}")) == k).alias(f"{k}{i}") for i in range(len(cols)) for k in kinds]
    full = [F.count_if(text_kind(F.col(f"c{i}")) != "null").alias(f"full{i}") for i in range(len(cols))]
    seen = plain.agg(*tests, *full).first()
    out = []
    for i in range(len(cols)):
        kind = next((t for k, t in kinds.items() if seen[f"full{i}"] and seen[f"{k}{i}"] == seen[f"full{i}"]), None)
        out.append((F.nullif(F.trim(f"c{i}"), F.lit("")).try_cast(kind) if kind else F.col(f"c{i}")).alias(f"c{i}"))
    return plain.select(*place, *out).toDF(*place, *cols)


def dataset_path(spark: SparkSession, root: str, layer: str, name: str, version: int | None = None) -> str:
    """Where a dataset's text is: of a cleaned one its current version, or the one that it had at a number of the log."""
    from lodeflow.sources import versions

    return versions.path_of(spark, root, layer, name, version)


def read_dataset(spark: SparkSession, root: str, layer: str, name: str, typed: bool = True, ordered: bool = False, version: int | None = None) -> DataFrame:
    return read_csv(spark, dataset_path(spark, root, layer, name, version), typed, ordered)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Cells as they are: no trimming, nulls and empty text both as nothing. Rows that have places are written in order."""
    chosen = columns or [c for c in df.columns if c != ROW]
    rows = df.orderBy(ROW) if ROW in df.columns else df
    rows.select(*chosen).write.mode("overwrite").options(**CSV_WRITE).csv(path)


def silver_name(name: str) -> str:
    return f"{names.sanitized(name.split('__')[-1])}_cleaned"


def write_silver(df: DataFrame, root: str, name: str, based_on: int | None = None) -> str:
    """Overwrite the cleaned dataset of a name; its own name is the sanitised last segment and _cleaned.

    The rows are written as a new version, which becomes the current one at once when it is whole; df may read the dataset
    itself. With based_on, the version that df was made from, a later one of someone else is not replaced (versions.Conflict).
    """
    from lodeflow.sources import versions

    out, folder = silver_name(name), uuid.uuid4().hex
    write_csv(df, versions.folder_of(root, "Silver", out, folder))
    versions.commit(df.sparkSession, root, "Silver", out, folder, based_on)
    return out


def write_gold(df: DataFrame, root: str, name: str) -> None:
    """Extension: results for analytics as Parquet, flat columns for reporting tools."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{names.PREFIXES['Gold']}/{names.sanitized(name)}/data.parquet")


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Extension: to a relational database; the driver's jar and credentials are the session's."""
    df.write.mode("overwrite").jdbc(url, table, properties=properties)


def metadata_log(spark: SparkSession, root: str):
    """The log of changes to metadata records. `whole` entries replace a record, others set the fields that they name."""
    from lodeflow.sources.log import Log

    return Log(spark, f"{root.rstrip('/')}/{names.METADATA_LOG}", f"layer string, name string, whole boolean, {METADATA_SCHEMA}")


def metadata_table(spark: SparkSession, root: str) -> DataFrame:
    """(layer, name, display_name, owner, division_override, archived) of all records; none if there are none.

    One JSON file each, as other programs write them, and all later changes by the log. Changes of one record by many
    writers at once are all there; of one field the last one is.
    """
    fields = METADATA_FIELDS
    none = spark.createDataFrame([], f"layer string, name string, whole boolean, {METADATA_SCHEMA}, at bigint, line bigint")
    fs, p = file_system(spark, f"{root.rstrip('/')}/{names.METADATA}")
    if fs.exists(p):
        texts = spark.read.text(p.toString(), wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", METADATA_SCHEMA).alias("m"))
        stem = F.regexp_replace(F.url_decode("file"), r"\.json\z", "")
        plain = texts.select(F.substring_index(stem, "__", 1).alias("layer"), F.regexp_replace(stem, r"\A[^_]*__", "").alias("name"), F.lit(True).alias("whole"), "m.*")
        none = none.unionByName(plain.withColumns({"at": F.lit(-2).cast("long"), "line": F.lit(0).cast("long")}))
    return _records(none.unionByName(metadata_log(spark, root).read())).select("layer", "name", *fields)


def _records(changes: DataFrame) -> DataFrame:
    """What changes come to: of each record, the last one that is whole and the fields set since."""
    from lodeflow.sources.log import last_of

    order = F.struct("at", "line")
    whole = F.max(F.when(F.col("whole"), order)).over(Window.partitionBy("layer", "name"))
    since = changes.withColumn("from_", whole).where(F.col("from_").isNull() | (order >= F.col("from_")))
    return last_of(since, ["layer", "name"], list(METADATA_FIELDS), F.max("whole").alias("whole"))


def load_metadata(spark: SparkSession, root: str, layer: str, name: str) -> dict:
    """A dataset's record, its fields that are set; {} where there is none or it can't be read."""
    row = metadata_table(spark, root).where((F.col("layer") == layer) & (F.col("name") == name)).first()
    return {c: row[c] for c in METADATA_FIELDS if row[c] is not None} if row else {}


def _change(spark: SparkSession, root: str, layer: str, name: str, whole: bool, record: dict) -> None:
    metadata_log(spark, root).append({"layer": layer, "name": name, "whole": whole} | {c: record[c] for c in METADATA_FIELDS if record.get(c) is not None})


def save_metadata(spark: SparkSession, root: str, layer: str, name: str, record: dict) -> None:
    """Replace a dataset's record."""
    _change(spark, root, layer, name, True, record)


def rename(spark: SparkSession, root: str, layer: str, name: str, display_name: str) -> None:
    shown = display_name.strip()
    if not shown:
        raise ValueError("a name can't be empty")
    _change(spark, root, layer, name, False, {"display_name": shown})


def archive(spark: SparkSession, root: str, layer: str, name: str) -> None:
    _change(spark, root, layer, name, False, {"archived": True})


def compact_metadata(spark: SparkSession, root: str) -> None:
    """Put the log's entries into a snapshot."""
    metadata_log(spark, root).compact(_records)


def download(spark: SparkSession, root: str, layer: str, name: str, folder: str) -> str:
    """Copy a dataset's text out as one file, <last segment>.csv; a folder of parts is put together under one header: by
    tasks and the file system where that can link files (HDFS, local disks), else by a stream through the driver."""
    source, target = dataset_path(spark, root, layer, name), f"{folder.rstrip('/')}/{name.split('__')[-1]}.csv"
    fs, p = file_system(spark, source)
    if fs.exists(p) and not fs.getFileStatus(p).isDirectory():
        copy_file(spark, source, target)
        return target
    parts = sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-") and f.getLen())
    if len(parts) == 1:
        copy_file(spark, parts[0], target)
    elif not parts or not _joined(spark, parts, target):
        _streamed(spark, parts, target)
    return target


def _skip_header(stream) -> bytes:
    """Read a part's first line, its header; a quoted name may hold line feeds."""
    out, quoted, byte = bytearray(), False, stream.read()
    while byte >= 0:
        out.append(byte)
        if byte == 10 and not quoted:
            break
        quoted ^= byte == 34
        byte = stream.read()
    return bytes(out)


def _joined(spark: SparkSession, parts: list[str], target: str) -> bool:
    """Put parts together under one header without the driver: tasks write the parts' other lines, in their order, and the
    file system links the pieces. False, and nothing done, where it can't link."""
    fs, p = file_system(spark, target)
    local = fs.getUri().getScheme() == "file"
    plain = fs.getRawFileSystem() if local else fs  # files with checksums beside them can't be linked
    if not plain.hasPathCapability(p, "fs.capability.paths.concat"):
        return False
    from lodeflow.sources.records import lines_after

    part_fs, part_path = file_system(spark, parts[0])
    stream = part_fs.open(part_path)
    try:
        header = _skip_header(stream)
    finally:
        stream.close()
    folder = f"{target}.{uuid.uuid4().hex}"
    lines_after(spark, parts, header.count(b"\n")).write.option("lineSep", "\n").option("compression", "none").text(folder)
    head = file_system(spark, f"{folder}/head")[1]
    out = plain.create(head, True)
    try:
        out.write(bytearray(header))
    finally:
        out.close()
    pieces = sorted(f.getPath().toString() for f in fs.listStatus(file_system(spark, folder)[1]) if f.getPath().getName().startswith("part-") and f.getLen())
    pieces = [file_system(spark, piece)[1] for piece in pieces]
    whole = file_system(spark, f"{folder}/whole")[1] if local else head
    sources = [head, *pieces] if local else pieces  # local files: into a new one; others: onto the first
    if sources:
        array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(sources))
        for i, source in enumerate(sources):
            array[i] = source
        plain.concat(whole, array)
    fs.delete(p, False)
    plain.rename(whole, p)
    fs.delete(file_system(spark, folder)[1], True)
    return True


def _streamed(spark: SparkSession, parts: list[str], target: str) -> None:
    """The same through the driver, for stores that can't link files; a stream, nothing is held."""
    out_fs, out_path = file_system(spark, target)
    out = out_fs.create(out_path, True)
    try:
        for k, part in enumerate(parts):
            part_fs, part_path = file_system(spark, part)
            stream = part_fs.open(part_path)
            try:
                if k:
                    _skip_header(stream)
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
    finally:
        out.close()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
