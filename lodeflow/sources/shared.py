"""The folder that driver and executors share, steps written there, and this package on the workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_lodeflow_shipped", False):
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='lodeflow-')}/lodeflow", "zip", root, "lodeflow"))
        sc._lodeflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder serves in local mode only; on a cluster that would be a
    disk of each machine."""
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
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
