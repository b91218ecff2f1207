"""Extension: a job monitor that outlives the run: what streams report, kept as files in the lake."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lodeflow.sources.store import file_system, put_text

JOBS_SCHEMA = "job string, run string, event string, batch bigint, rows bigint, ms bigint, behind bigint, error string, at timestamp"


class JobMonitor(StreamingQueryListener):
    """Keeps an event for each start, batch and end of the streams of a session, under the job's name.

    Events of a stream are one file, put when it ends, or after FLUSH events; a driver that dies loses what it had not yet
    put. behind: log entries that the source had and the batch didn't take.
    """

    FLUSH = 100

    def __init__(self, spark: SparkSession, path: str, job: str):
        self.spark, self.path, self.job = spark, path.rstrip("/"), job
        self.events: dict[str, list[dict]] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _keep(self, run: str, last: bool = False, **what) -> None:
        with self.lock:
            own = self.events.setdefault(run, [])
            own.append({"job": self.job, "run": run, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())} | what)
            if last or len(own) >= self.FLUSH:
                put_text(self.spark, f"{self.path}/{run}-{uuid.uuid4().hex}.json", "".join(json.dumps(e) + "\n" for e in own))
                self.events[run] = []
        if last:
            self.ended.setdefault(run, threading.Event()).set()

    def onQueryStarted(self, event) -> None:
        self._keep(str(event.runId), event="started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        behind = 0
        for s in p.sources:
            try:
                behind += max(0, json.loads(s.latestOffset)["logOffset"] - json.loads(s.endOffset)["logOffset"])
            except (TypeError, ValueError, KeyError):
                pass  # a source that counts otherwise
        self._keep(str(p.runId), event="batch", batch=p.batchId, rows=p.numInputRows, ms=p.batchDuration, behind=behind)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        error = event.exception.strip().splitlines()[0][:500] if event.exception else None
        self._keep(str(event.runId), True, event="failed" if error else "ended", error=error)

    def wait(self, run: str, seconds: float = 30) -> bool:
        """Until a run's end is kept: events come a little later than the run ends."""
        return self.ended.setdefault(run, threading.Event()).wait(seconds)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """All events that are kept; none if there is no folder."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], JOBS_SCHEMA)
    return spark.read.schema(JOBS_SCHEMA).json(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each run: job, run, batches, rows, ms, how it ended (running: not yet), error."""
    each = jobs(spark, path).groupBy("job", "run")
    return each.agg(
        F.count_if((F.col("event") == "batch") & (F.col("rows") > 0)).alias("batches"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"),
        F.coalesce(F.max(F.when(F.col("event").isin("ended", "failed"), F.col("event"))), F.lit("running")).alias("state"),
        F.max("error").alias("error"),
        F.min("at").alias("began"),
    )
