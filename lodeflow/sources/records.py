"""CSV records from files that are read in blocks, by many tasks, in their order.

A quoted cell may hold line feeds, so a block's first line can stand inside one. A line is a small function: it starts
outside or inside quotes, and ends outside or inside. A first pass finds, for each block and both ways to start, how it ends
and how many records begin in it: one row a block. Put together over a file's blocks these say how each block starts and
how many records stand before it. A second pass cuts the records; those that cross blocks leave pieces, which are joined.

So a record has a place: its file, in the order of names, and its number there. `ROW` is that place over all files of a
dataset, without gaps: operators that need a first row take it where a frame has it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeflow.sources.shared import ship, staged

#: The column with a row's place; it is no data column. Its type is any that can be ordered.
ROW = "_row_"
#: Blocks sent to all workers: one row for each block but a file's first. More go by a shuffled join.
SMALL = 200_000

# A cell ends before a comma; one that opens with a quote goes on to its closing quote, whatever stands between. Behind the
# closing quote, up to the next comma, quotes have no meaning.
_REST = r"""(?:[^"]|"")*+"""
_CELL = rf"""(?:"{_REST}"[^,]*+|[^",][^,]*+|)"""
_OPENS = re.compile(rf"""(?:{_CELL},)*+"{_REST}\Z""")
_STAYS = re.compile(rf"""{_REST}(?:"[^,]*+,(?:{_CELL},)*+"{_REST})?\Z""")

BLOCK_DDL = "file bigint, block bigint, end0 boolean, end1 boolean, n0 bigint, n1 bigint, header string"
PIECE_DDL = "file bigint, block bigint, place bigint, kind string, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts outside or inside a quoted cell ends inside one."""
    return bool((_STAYS if inside else _OPENS).match(line))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    at = F.col("_metadata")
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", False).text(path).select(F.xxhash64(at["file_path"]).alias("file"), at["file_block_start"].alias("block"), F.col("value").alias("line"))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, block, lines): each batch cut where the block changes."""
    for batch in batches:
        file, block = (batch.column(i).to_numpy() for i in range(2))
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(file)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(file[a]), int(block[a]), batch.column(2).slice(a, b - a)


def _quoted(lines: pa.Array) -> list[tuple[int, str]]:
    """The lines with a quote: all others leave the state as it is."""
    where = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    return list(zip(where.tolist(), lines.take(pa.array(where)).to_pylist(), strict=True))


def _states(quoted: list[tuple[int, str]], inside: bool, n: int) -> tuple[np.ndarray, bool]:
    """Whether each line starts inside quotes, and whether the last one ends there."""
    turns, first = [], int(inside)
    for k, line in quoted:
        after = ends_inside(line, inside)
        if after != inside:
            turns.append(k + 1)
            inside = after
    out = np.zeros(n + 1, np.int64)
    np.add.at(out, turns, 1)
    return ((np.cumsum(out)[:n] + first) & 1).astype(bool), inside


def _is_blank(lines: pa.Array) -> np.ndarray:
    return pc.or_(pc.equal(lines, ""), pc.equal(lines, "\r")).to_numpy(zero_copy_only=False)


def blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a block: how it ends and how many records begin in it, for both ways to start; the header of a file's first
    block (its first record, if it ends there). Counts leave blank lines out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, rows = None, None, []

        def keep() -> None:
            if row is not None:
                rows.append((*own, row["end"][0], row["end"][1], row["n"][0], row["n"][1], "\n".join(row["header"]) if row["header"] else None))

        for file, block, lines in _blocks_of(batches):
            if (file, block) != own:
                keep()
                own, row = (file, block), {"end": [False, True], "n": [0, 0], "header": [], "done": block != 0}
            quoted, blank = _quoted(lines), _is_blank(lines)
            for k in (0, 1):
                starts, row["end"][k] = _states(quoted, row["end"][k], len(lines))
                row["n"][k] += int((~starts & ~blank).sum())
                if k == 0 and not row["done"]:
                    _head(row, lines, starts, blank, row["end"][0])
        keep()
        for at in range(0, len(rows), 1000):
            part = rows[at : at + 1000]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], ["file", "block", "end0", "end1", "n0", "n1", "header"])

    ship(spark)
    return _lines(spark, path).mapInArrow(run, BLOCK_DDL)


def _head(row: dict, lines: pa.Array, starts: np.ndarray, blank: np.ndarray, end: bool) -> None:
    """Gather a file's first record."""
    for k in range(len(lines)):
        if not row["header"] and blank[k] and not starts[k]:
            continue
        row["header"].append(lines[k].as_py())
        inside = starts[k + 1] if k + 1 < len(lines) else end
        if not inside:
            row["done"] = True
            row["header"][-1] = row["header"][-1].removesuffix("\r")
            return


def _file_order(path: Column) -> list[Column]:
    """Files by folder, then by the number of a part, then by name."""
    return [F.regexp_replace(path, r"[^/]*\z", ""), F.regexp_extract(path, r"/part-([0-9]+)[^/]*\z", 1).try_cast("long"), path]


def digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, digest: the SHA-256 of each block's lines as they are, whatever their encoding. Only a last line feed, and
    a byte-order mark, leave no trace in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, rows = None, None, []
        for file, block, lines in _blocks_of(batches):
            if (file, block) != own:
                rows += [(*own, state.hexdigest())] if own else []
                own, state = (file, block), hashlib.sha256()
            for line in lines.to_pylist():
                state.update(line + b"\n")
        rows += [(*own, state.hexdigest())] if own else []
        kinds = [pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "block", "digest"])

    ship(spark)
    return _lines(spark, path).withColumn("line", F.col("line").cast("binary")).mapInArrow(run, "file bigint, block bigint, digest string")


def placed_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, inside, before, base, header: whether a block starts inside quotes, records before it in its file, and in
    the files before it, headers left out there.

    A block's function is constant, identity or swap. How a block starts is what the last constant one before it says,
    turned as often as swaps came since. One row a block; those of one file pass through one task, and one row a file.
    """
    rows = _resolved(blocks(spark, path))
    names = _names(spark, path)
    totals = rows.groupBy("file").agg(F.sum("n").alias("total")).join(names, "file")
    base = F.coalesce(F.sum(F.greatest(F.col("total") - 1, F.lit(0))).over(Window.orderBy(*_file_order(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("file", base.alias("base"))
    return rows.join(bases, "file").select("file", "block", "inside", "n", "before", "base", "header")


def _resolved(found: DataFrame) -> DataFrame:
    """Blocks with inside, n and before: how each starts, so how many records begin in it, and how many before it."""
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("end0") == F.col("end1")
    rows = found.withColumn("swap", (F.col("end0") & ~F.col("end1")).cast("int"))
    rows = rows.withColumn("swaps", F.sum("swap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.last(F.when(fixed, F.struct("end0", "swaps")), ignorenulls=True).over(past)
    rows = rows.withColumn("known", known).withColumn("turned", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    since = F.col("turned") - F.coalesce(F.col("known.swaps"), F.lit(0))
    rows = rows.withColumn("inside", F.coalesce(F.col("known.end0"), F.lit(False)) != (since % 2 == 1))
    rows = rows.withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")))
    return rows.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0)))


def file_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, rows, header of each file: its records but the header, and the header's text. One pass, in blocks."""
    each = _resolved(blocks(spark, path)).groupBy("file").agg(F.sum("n").alias("n"), F.max("header").alias("header"))
    return each.join(_names(spark, path), "file").select("path", F.greatest(F.col("n") - 1, F.lit(0)).alias("rows"), "header")


def _names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, path of all files of a dataset; nothing is read."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), "path")


def numbered(df: DataFrame, order: str | Column, out: str) -> DataFrame:
    """df with each row's number from 0 in an order, without gaps. Rows are sorted over all tasks and written; how many stand
    before a task's rows comes from the tasks' counts, one row each."""
    own, at = "_part_", "_at_"
    rows = staged(df.orderBy(order).withColumns({own: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col(own).alias("part")).agg(F.count("*").alias("n"))
    starts = counts.select(F.col("part").alias("_task_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before_"))
    placed = rows.join(F.broadcast(starts), F.col(own) == F.col("_task_"))  # one row a task
    return placed.select(*df.columns, (F.col("_before_") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(out))


def lines_after(spark: SparkSession, paths: list[str], skip: int) -> DataFrame:
    """line: the lines of files as they are, in the files' and their own order, but the first ones of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = None, 0
        for batch in batches:
            for file, block, lines in _blocks_of(iter([batch])):
                seen = seen if (file, block) == own else 0
                own, first = (file, block), min(len(lines), max(0, skip - seen)) if block == 0 else 0
                places = np.arange(seen + first, seen + len(lines))
                seen += len(lines)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), file)), pa.array(np.full(len(places), block)), pa.array(places), lines.slice(first)], ["file", "block", "place", "line"])

    ship(spark)
    rows = _lines(spark, paths).mapInArrow(run, "file bigint, block bigint, place bigint, line string")
    order = Window.orderBy(*_file_order(F.col("path")))
    parts = _names(spark, paths).select(F.col("file").alias("f"), F.row_number().over(order).alias("part"))  # one row a file
    return rows.join(F.broadcast(parts) if len(paths) <= SMALL else parts, F.col("file") == F.col("f")).orderBy("part", "block", "place").select("line")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """_row_, record: the text of each record but each file's first, its header. Blank lines are no records.

    A record that crosses blocks is put together from its pieces, in one row of one task.
    """
    table = staged(placed_blocks(spark, path), "blocks")
    later = table.where("block > 0").select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("inside").alias("starts"))
    lines = _lines(spark, path)
    many = later.count()
    if many == 0:
        lines = lines.withColumn("starts", F.lit(False))
    elif many <= SMALL:
        lines = lines.join(F.broadcast(later), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left").drop("f", "b")
    else:
        numbered = lines.withColumn("line_", F.monotonically_increasing_id())
        lines = numbered.join(later, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left").drop("f", "b")
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "block", "line_").drop("line_")
    pieces = lines.select("file", "block", "line", F.coalesce("starts", F.lit(False)).alias("starts")).mapInArrow(_cut, PIECE_DDL)
    whole = pieces.where("kind = 'whole'").select("file", "block", "place", "record")
    if many:
        # what a block leaves open goes on in the blocks behind it, up to the first in which it ends
        open_ = pieces.where("kind <> 'whole'")
        order = Window.partitionBy("file").orderBy("block", "place")
        begun = F.last(F.when(F.col("kind") == "open", F.struct("block", "place")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        joined = open_.withColumn("own", begun).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("block", "place", "record"))).alias("parts"))
        text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
        whole = whole.union(joined.select("file", "own.block", "own.place", F.regexp_replace(text, "\r\\z", "")))
    placed = whole.join(table.select(F.col("file").alias("f"), F.col("block").alias("b"), "before", "base"), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    inside = F.col("before") + F.col("place")
    return placed.where(inside > 0).select((F.col("base") + inside - 1).alias(ROW), "record")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block. Kinds: whole; open, the block's last record if it doesn't end there; more, the lines at a
    block's start that go on with a record begun before it. place is the record's number in its block; that of more is -1."""
    own, inside, place, held, kind = None, False, 0, [], ""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], ["file", "block", "place", "kind", "record"])

    def left() -> list[tuple]:
        return [(*own, place if kind == "open" else -1, kind, "\n".join(held))] if held else []

    for batch in batches:
        starts = dict(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(3).to_pylist(), strict=True))
        for file, block, lines in _blocks_of(iter([batch])):
            out = []
            if (file, block) != own:
                out += left()
                own, place, held = (file, block), 0, []
                inside = starts[own]
                kind = "more" if inside else "open"
            states, end = _states(_quoted(lines), inside, len(lines))
            for k, (line, within) in enumerate(zip(lines.to_pylist(), states.tolist(), strict=True)):
                after = bool(states[k + 1]) if k + 1 < len(lines) else end
                if not within and not after:
                    line = line.removesuffix("\r")
                    if line:
                        out.append((*own, place, "whole", line))
                        place += 1
                    continue
                held.append(line)
                if not after:
                    if kind == "more":
                        out += left()
                        kind = "open"
                    else:
                        out.append((*own, place, "whole", "\n".join(held).removesuffix("\r")))
                        place += 1
                    held = []
            inside = end
            for at in range(0, len(out), 5000):
                yield rows(out[at : at + 5000])
    if own is not None and held:
        yield rows(left())
