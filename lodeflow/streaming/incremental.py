"""Extension: incremental flow from Bronze files to a cleaned Silver table, and on to Gold aggregates.

Each run takes the files that are new since the last one (Structured Streaming's file source with a checkpoint and the
availableNow trigger), cleans them batch by batch and appends Parquet.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeflow.operators.clean import clean
from lodeflow.sources.store import CSV_READ


def bronze_stream(spark: SparkSession, folder: str, columns: Iterable[str]) -> DataFrame:
    """New CSV files of one dataset type as a stream of text columns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.options(**CSV_READ).schema(schema).csv(folder)


def run_incremental(spark: SparkSession, folder: str, columns: Iterable[str], target: str, checkpoint: str, operations: Iterable[str] = ("trim", "dedupe")) -> StreamingQuery:
    """Clean the new files into target (Parquet, a folder for each batch); returns the finished query.

    A batch that is run again overwrites its own folder, so none is taken twice. dedupe works within a batch. Types are
    not voted here: a vote over part of the data could differ from batch to batch.
    """
    chosen = [o for o in operations if o != "fix_types"]

    def one(batch: DataFrame, number: int) -> None:
        clean(batch, chosen).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    query = bronze_stream(spark, folder, columns).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress(query: StreamingQuery) -> list[dict]:
    """A job monitor's rows: batch, rows taken, milliseconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in query.recentProgress]


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by key and time window; on a stream, events later than `late` drop out and windows close."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), key, "n")
