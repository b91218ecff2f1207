import pytest
from pyspark.errors import StreamingQueryException

from lodeflow.sources.shared import shared_path
from lodeflow.sources.store import put_text
from lodeflow.streaming.flow import Flow
from lodeflow.streaming.monitor import jobs, runs


def test_two_runs_and_a_failed_one(spark):
    root = shared_path(spark, "jobs")
    assert jobs(spark, f"{root}/jobs").count() == 0
    flow = Flow(spark, f"{root}/in", ["k"], f"{root}/out", ["dedupe"])
    for k in range(2):
        put_text(spark, f"{root}/in/{k}.csv", f"k\n{k}\n{k}\n")
        flow.run(f"{root}/jobs", f"run {k}")
    put_text(spark, f"{root}/bad/votes", "no folder")
    with pytest.raises(StreamingQueryException):
        Flow(spark, f"{root}/in", ["k"], f"{root}/bad", ["dedupe"]).run(f"{root}/jobs", "bad")
    found = [(r["job"], r["state"], r["batches"]) for r in runs(spark, f"{root}/jobs").orderBy("job").collect()]
    assert found == [("bad", "failed", 0), ("run 0", "ended", 1), ("run 0", "ended", 1), ("run 1", "ended", 1), ("run 1", "ended", 1)]
    assert all(r["error"] for r in runs(spark, f"{root}/jobs").where("state = 'failed'").collect())
    assert {r["event"] for r in jobs(spark, f"{root}/jobs").select("event").distinct().collect()} == {"started", "batch", "ended", "failed"}
    assert flow.read().count() == 2
