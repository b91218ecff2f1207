import pytest
from pyspark.sql import functions as F

from lodeflow.llm.mixing import golden_point, mix, op6_golden_ratio_mix


def water(sizes, weights, most=3):
    """Targets by raising capped sources one round after another."""
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weights[s] for s in sizes if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weights[s] / share for s in sizes}
        over = {s for s in sizes if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 3 + [None] * 40)]
    docs, schedule = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16)
    got = docs.collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = water(sizes, {"a": 1, "b": 2, "c": 3, None: 1})
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    # any run of slots holds each source near its share
    slots = schedule.groupBy("slot").agg(F.first("source").alias("s")).orderBy("slot").collect()
    half = [r["s"] for r in slots[: len(slots) // 2]]
    for s, t in want.items():
        assert abs(half.count(s) / len(half) - t / sum(want.values())) < 0.1


def test_reruns_agree(spark, data):
    a, b = (sorted(map(tuple, op6_golden_ratio_mix(spark, data).collect())) for _ in "12")
    assert a == b


def test_takes_of_the_driver_table(spark, data):
    """A second way: the words of each source, documents in hashed order, read round until the target."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source", F.xxhash64("doc_id", F.lit(6)).alias("h")).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    got = {r["doc_id"]: r for r in op6_golden_ratio_mix(spark, data).collect()}
    assert all(got[i]["size"] == size[i] for i in size)
    sources = sorted({r["source"] for r in rows})
    sizes = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    want = water(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)})
    for s in sources:
        left = round(want[s])
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["h"], r["doc_id"]))
        taken = dict.fromkeys((r["doc_id"] for r in own), 0)
        for _ in range(3):
            for r in own:
                n = min(left, size[r["doc_id"]])
                taken[r["doc_id"]] += n
                left -= n
        assert {i: got[i]["taken"] for i in taken} == taken
        assert all((got[i]["slots"] > 0) == (n > 0) == (got[i]["first_slot"] is not None) for i, n in taken.items())


def test_every_prefix_is_near_the_targets(spark, data):
    """The schedule's discrepancy: in each run of slots from the first, each source has its share, within a few slots."""
    docs, schedule = mix(spark.read.parquet(f"{data}/documents.parquet"), block=32)
    target = {r["source"]: r["target"] for r in docs.select("source", "target").distinct().collect()}
    slots = [r["source"] for r in schedule.groupBy("slot").agg(F.first("source").alias("source")).orderBy("slot").collect()]
    seen, most = dict.fromkeys(target, 0), 0.0
    for n, s in enumerate(slots, 1):
        seen[s] += 1
        most = max(most, *(abs(seen[x] - n * t / sum(target.values())) for x, t in target.items()))
    assert len(slots) > 1000 and most < 6
    # and each slot's block has a slot's words
    words = [r["w"] for r in schedule.groupBy("slot").agg(F.sum(F.col("last_word") - F.col("first_word")).alias("w")).collect()]
    assert min(words) >= 30 and max(words) <= 34


def test_golden_points(spark):
    got = [r[0] for r in spark.range(5).select(golden_point(F.col("id"))).collect()]
    assert got == pytest.approx([(k * 0.6180339887498949) % 1 for k in range(5)], abs=1e-8)
    assert spark.range(2**40, 2**40 + 1000).select(golden_point(F.col("id")).alias("x")).where("x < 0 or x >= 1").count() == 0


def test_edges(edge, empty):
    docs, schedule = mix(edge)
    got = docs.collect()
    assert len(got) == 11 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=4)
    docs, schedule = mix(empty)
    assert docs.count() == 0 and schedule.count() == 0
