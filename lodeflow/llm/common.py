"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_lodeflow_shipped", False):
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='lodeflow-')}/lodeflow", "zip", root, "lodeflow"))
        sc._lodeflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode only; on a cluster that would be a disk of each machine.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_lodeflow_folder"):
        sc._lodeflow_folder = f"file://{tempfile.mkdtemp(prefix='lodeflow-')}"
    return sc._lodeflow_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it is deleted when the driver's JVM ends, if it is still there."""
    path = f"{shared_dir(spark)}/lodeflow/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeflow_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Delete what staged() has written, once no later step reads it. Other frames stay as they are."""
    if path := getattr(df, "_lodeflow_path", None):
        remove(df.sparkSession, path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names. Other columns may clash with them in any way; an exact match wins."""
    ship(df.sparkSession)
    place = {}
    for new, old in columns.items():
        found = [i for i, c in enumerate(df.columns) if c == old] or [i for i, c in enumerate(df.columns) if c.lower() == old.lower()]
        if not found:
            raise ValueError(f"no column {old!r} in {df.columns}")
        place[new] = found[0]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in place.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents under their own names, whatever else a table holds."""
    return pick(docs, doc_id="doc_id", text="text", lang="lang", source="source", n_chars="n_chars")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def portions(sizes: Iterable[int], budget: int) -> Iterator[slice]:
    """Runs of rows whose sizes add up to about the budget; a row over it stands alone."""
    start = total = n = 0
    for size in sizes:
        if n > start and total + size > budget:
            yield slice(start, n)
            start, total = n, 0
        total, n = total + size, n + 1
    if n > start:
        yield slice(start, n)


def parts_of(batches: Iterator[pd.DataFrame], budget: int, column: str = "text") -> Iterator[pd.DataFrame]:
    """The batches cut into runs of rows whose texts add up to about the budget, so that copies stay small."""
    for batch in batches:
        for span in portions([len(t) if isinstance(t, str) else 0 for t in batch[column]], budget):
            yield batch.iloc[span]


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, equal on every worker."""
    if not words:
        return np.empty(0, np.uint64)
    spread = np.empty(len(words), object)
    spread[:] = words
    return pd.util.hash_array(spread, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str, chunk: Column) -> DataFrame:
    """Add out = sum of value over the rows before, in the order given within each group.

    chunk must rise with the order. Sums run inside chunks and over the table of chunk totals, so no group has to fit
    one task. Chunks are few thousand rows each, their table is small.
    """
    from pyspark.sql import Window

    rows = df.withColumn("chunk_", chunk)
    before = Window.partitionBy(*group).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "chunk_").agg(F.sum(value).alias("total_")).withColumn("base_", F.coalesce(F.sum("total_").over(before), F.lit(0))).drop("total_")
    inside = Window.partitionBy(*group, "chunk_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    keys = [*group, "chunk_"]
    b = totals.toDF(*[f"{c}b" if c in keys else c for c in totals.columns])
    match = F.lit(True)
    for k in keys:
        match = match & own[k].eqNullSafe(b[f"{k}b"])
    return own.join(b, match, "left").withColumn(out, F.col("own_") + F.col("base_")).drop("own_", "base_", "chunk_", *[f"{k}b" for k in keys])
