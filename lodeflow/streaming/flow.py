"""Extension: an incremental flow whose result is that of one full pass over all files.

Two streams read the same new files. One counts: votes of column types and sums by key, a record for each batch, which add
up. The other keeps rows: a row that any batch has had before, in this run or an earlier one, drops out by keyed state in
the checkpoint. Types are decided when rows are read, by all votes so far, so a column that crosses the threshold needs no
rewriting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import cells as readings
from lodeflow.functions.cells import label, number
from lodeflow.operators.clean import OPERATIONS, _over_texts, dedupe, fill_missing, fix_types, votes_of
from lodeflow.sources.records import ROW
from lodeflow.sources.store import file_system
from lodeflow.streaming.incremental import bronze_stream
from lodeflow.streaming.monitor import JobMonitor

#: The state of keys lives on the executors' disks, in changelogs in the checkpoint, not in their heaps.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class Partials:
    """Records that add up: a folder for each batch, and folds of many batches into one.

    A batch that is run again overwrites its own folder. A fold covers all batches up to a number and counts once it is
    complete; what an earlier fold had covered goes then, so a reader that began before still finds its files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, number: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def _folders(self, kind: str) -> list[int]:
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return []
        found = [re.fullmatch(rf"{kind}=([0-9]+)", s.getPath().getName()) for s in fs.listStatus(p)]
        return sorted(int(m[1]) for m in found if m and fs.exists(file_system(self.spark, f"{self.path}/{m[0]}/_SUCCESS")[1]))

    def _current(self) -> tuple[int, list[str]]:
        """The last batch that is covered, and the folders to read."""
        folds, batches = self._folders("upto"), self._folders("batch")
        done = folds[-1] if folds else -1
        paths = [f"{self.path}/upto={done}"] * bool(folds) + [f"{self.path}/batch={n}" for n in batches if n > done]
        return max([done, *batches]), paths

    def read(self) -> DataFrame | None:
        """All records, or None if there are none."""
        paths = self._current()[1]
        return self.spark.read.parquet(*paths) if paths else None

    def fold(self, add: Callable[[DataFrame], DataFrame]) -> None:
        """Put all records into one folder, added up."""
        last, paths = self._current()
        if len(paths) < 2:
            return
        covered = self._folders("upto")
        add(self.spark.read.parquet(*paths)).write.mode("overwrite").parquet(f"{self.path}/upto={last}")
        for n in covered[:-1]:
            self._delete(f"upto={n}")
        for n in self._folders("batch"):
            if covered and n <= covered[-1]:
                self._delete(f"batch={n}")

    def _delete(self, name: str) -> None:
        fs, p = file_system(self.spark, f"{self.path}/{name}")
        fs.delete(p, True)


def partial_sums(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, total, n): sums of a measure's cells by key, as group_sum takes them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(F.col(x).cast("string").alias("x"), number(F.col(y), kinds[y], True).alias("v")).where(~F.isnan("v"))
    return rows.groupBy("x").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def added_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("x").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def added_votes(parts: DataFrame) -> DataFrame:
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


class Flow:
    """One dataset's files in `folder`, kept clean below `target`; `sums` are (key, measure) pairs kept up to date.

    target holds rows, votes, sums and the streams' checkpoints. Operations and columns must stay the same over its life.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: Iterable[str], target: str, operations: Iterable[str], sums: Iterable[tuple[str, str]] = ()):
        self.columns, self.operations, self.sums = list(columns), set(operations), list(sums)
        if not self.operations or self.operations - set(OPERATIONS):
            raise ValueError(f"operations must be some of {OPERATIONS}")
        if ROW in self.columns or set(sum(self.sums, ())) - set(self.columns):
            raise ValueError("sums are of the dataset's columns")
        self.spark, self.folder, self.target = spark, folder, target.rstrip("/")
        self.votes = Partials(spark, f"{self.target}/votes")

    def _kept(self, x: str, y: str) -> Partials:
        return Partials(self.spark, f"{self.target}/sums/{self.columns.index(x)}-{self.columns.index(y)}")

    def _cells(self, df: DataFrame) -> DataFrame:
        """What each row can be given alone."""
        if "trim" in self.operations:
            df = _over_texts(df, readings.trim)
        return _over_texts(df, readings.title_case, True) if "normalize_case" in self.operations else df

    def run(self, jobs: str | None = None, job: str = "flow") -> None:
        """Take the files that are new since the last run. The session's own settings stay as they are. jobs: a folder that
        keeps what the monitor sees, under the job's name."""
        own = self.spark.newSession()
        for k, v in STATE.items():
            own.conf.set(k, v)
        rows = self._cells(bronze_stream(own, self.folder, self.columns))

        def count(batch: DataFrame, n: int) -> None:
            self.votes.put(n, votes_of(batch, cells=True))
            for x, y in self.sums:
                self._kept(x, y).put(n, partial_sums(batch, x, y))

        def keep(batch: DataFrame, n: int) -> None:
            batch.select(self.columns).write.mode("overwrite").parquet(f"{self.target}/rows/batch={n}")

        once = rows
        if "dedupe" in self.operations:
            # rows of equal texts stay equal whatever the types; 256 bits tell all others apart
            once = rows.withColumn("key_", F.unhex(F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(self.columns)])), 256))).dropDuplicates(["key_"])
        monitor = JobMonitor(self.spark, jobs, job) if jobs else None
        if monitor:
            own.streams.addListener(monitor)
        begun = []
        try:
            for name, stream, each in (("count", rows, count), ("keep", once, keep)):
                query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.target}/marks/{name}").trigger(availableNow=True).start()
                begun.append(str(query.runId))
                query.awaitTermination()
        finally:
            if monitor:
                for run in begun:
                    monitor.wait(run)
                own.streams.removeListener(monitor)

    def read(self) -> DataFrame:
        """The dataset, as clean() would make it of all files: types by all votes, of rows that are equal then the first. No rows
        before the first run."""
        fs, p = file_system(self.spark, f"{self.target}/rows")
        if not fs.exists(p):
            return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in self.columns))
        out = self.spark.read.parquet(f"{self.target}/rows")
        out = out.select(F.struct("batch", F.monotonically_increasing_id()).alias(ROW), *self.columns)
        if "fix_types" in self.operations:
            votes = added_votes(self.votes.read()).first()
            out = fix_types(out, cells=True, votes={c: tuple(votes[3 * i + j] for j in range(3)) for i, c in enumerate(self.columns)})
        if "dedupe" in self.operations:
            out = dedupe(out, cells=True)
        if "fill_missing" in self.operations:
            out = fill_missing(out, cells=True)
        return out.drop(ROW)

    def top(self, x: str, y: str, groups: int = 20) -> DataFrame:
        """(label, total) of the largest sums over all files, from the kept ones alone; ties by key."""
        kept = self._kept(x, y).read()
        if kept is None:
            return self.spark.createDataFrame([], "label string, total double")
        best = added_sums(kept).orderBy(F.desc("total"), F.asc_nulls_first("x")).limit(groups)
        return best.select(label(F.col("x"), best.schema["x"].dataType).alias("label"), "total")

    def fold(self) -> None:
        """Put the records of many batches together; any time, as often as wanted."""
        self.votes.fold(added_votes)
        for x, y in self.sums:
            self._kept(x, y).fold(added_sums)
