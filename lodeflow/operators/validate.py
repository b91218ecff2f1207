"""Checks before ingestion, on a file's raw lines."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.cells import trim
from lodeflow.operators.contracts import contract_of
from lodeflow.sources import names, store

CHECKS = "array<struct<ok: boolean, message: string>>"


def header_of(line: Column) -> Column:
    """A header line's names: cut at bare commas, trimmed."""
    return F.transform(F.split(line, ",", -1), trim)


def checks(header_line: Column, data_lines: Column, required: Column) -> Column:
    """The three checks of a file: repeated names, required names, data lines; or one check if its first line is blank."""
    header = header_of(header_line)
    repeated = F.array_distinct(F.filter(header, lambda h: F.size(F.filter(header, lambda g: g == h)) > 1))
    missing = F.filter(required, lambda r: ~F.array_contains(header, r))

    def check(ok: Column, good: Column, bad: Column) -> Column:
        return F.struct(ok.alias("ok"), F.when(ok, good).otherwise(bad).alias("message"))

    listed = lambda a: F.array_join(a, ", ")
    # The messages' words.
    three = F.array(
        check(F.size(repeated) == 0, F.lit("No duplicate columns."), F.concat(F.lit("Duplicate column(s): "), listed(repeated))),
        check(F.size(missing) == 0, F.concat(F.lit("All required columns present ("), listed(required), F.lit(").")), F.concat(F.lit("Missing required column(s): "), listed(missing))),
        check(data_lines > 0, F.concat(data_lines.cast("string"), F.lit(" data row(s) found.")), F.lit("File has a header but no data rows.")),
    )
    empty = F.array(F.struct(F.lit(False).alias("ok"), F.lit("File is empty.").alias("message")))
    return F.when(trim(F.coalesce(header_line, F.lit(""))) == "", empty).otherwise(three)


def valid(found: Column) -> Column:
    return F.forall(found, lambda c: c["ok"])


def header_and_count(lines: DataFrame) -> DataFrame:
    """One row, header and n: the first of (block, line) and how many lines but one aren't blank. The first line is the first of the
    block with the least number, wherever that block is read; lines of one block come in their order."""
    placed = lines.select("line", F.struct("block", F.monotonically_increasing_id().alias("at")).alias("place"))
    return placed.agg(F.min_by("line", "place").alias("header"), (F.count_if(trim(F.col("line")) != "") - 1).alias("n"))


def validate_file(spark: SparkSession, path: str, division: str, kind: str) -> DataFrame:
    """(ok, message) for each check of one file; an unknown division or type gives one failing check."""
    contract = contract_of(division, kind)
    if contract is None:
        return spark.createDataFrame([(False, "Choose a division and dataset type first.")], "ok boolean, message string")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r\\z", "").alias("line"))
    both = header_and_count(lines)
    found = checks(F.col("header"), F.col("n"), F.array(*map(F.lit, contract.required)))
    return both.select(F.explode(found).alias("c")).select("c.ok", "c.message")


def ingest(spark: SparkSession, path: str, root: str, division: str, kind: str, now_ms: int | None = None, owner: str = "Workspace") -> str:
    """Validate, then copy the file unchanged to Bronze and write its metadata; returns the packed name.

    Metadata goes first: a failure between the two leaves a record without data, which no listing shows.
    """
    bad = [r["message"] for r in validate_file(spark, path, division, kind).where("not ok").collect()]
    if bad:
        raise ValueError("; ".join(bad))
    contract = contract_of(division, kind)
    file = path.rstrip("/").rsplit("/", 1)[-1]
    stub = file[:-4] if file.lower().endswith(".csv") else file
    stub = f"{names.sanitized(stub)}_{now_ms if now_ms is not None else int(time.time() * 1000)}"
    name = names.packed(division, kind, stub)
    store.save_metadata(spark, root, "Bronze", name, {"display_name": f"{contract.kind_label} — {file}", "owner": owner, "archived": False})
    store.copy_file(spark, path, names.path_of(root, "Bronze", name))
    return name
