import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    """The docs that each stage takes, and the last one's result."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = f"file://{tmp_path_factory.mktemp('p')}/{k}"
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_names(steps):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(df.columns == COLUMNS for df in steps[:-1])
    assert steps[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_decisions(spark, data, steps):
    from test_near_dedup import brute
    from test_winnowing import brute as hits

    groups = brute([(r["doc_id"], r["text"]) for r in steps[1].collect()], 2)
    assert ids(steps[2]) == {i for i, (c, _) in groups.items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    found = hits([(r["doc_id"], r["text"]) for r in steps[2].collect()], items)
    assert ids(steps[3]) == {i for i, _, n, _ in found if n == 0} and len(ids(steps[3])) < len(found)
    labels = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1")
    good = steps[0].join(labels, "doc_id", "left_semi")
    assert len(ids(good) - ids(steps[1])) <= 0.05 * good.count()
    assert steps[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    # the mix: a document as often as its words are taken, in the schedule's order
    from lodeflow.llm.mixing import mix

    taken = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mix(steps[3])[0].where("size > 0").collect()}
    found = [r["doc_id"] for r in steps[4].collect()]
    assert {i: found.count(i) for i in set(found)} == {i: n for i, n in taken.items() if n}
    first = {r["doc_id"]: r["first_slot"] for r in mix(steps[3])[0].where("taken > 0").collect()}
    order = [first[i] for k, i in enumerate(found) if i not in found[:k]]
    assert order == sorted(order)
    assert steps[5].count() == steps[4].count()


def test_run(spark, data, steps):
    assert sorted(map(tuple, cp.run(spark, data).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_rows_without_ids_are_mixed_each_for_itself(spark, data):
    """Words of each source are near its target, also where rows share an id or have none."""
    rows = [(None, f"{'w ' * (5 + i % 3)}", "en", "abc"[i % 3], 0) for i in range(40)] + [(7, f"v{i} " * 4, "en", "b", 0) for i in range(12)] + [(i, "x " * (1 + i % 9), "en", "c", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from lodeflow.llm.mixing import mix

    target = {r["source"]: r["target"] for r in mix(docs)[0].select("source", "target").distinct().collect()}
    got = cp.mixing_stage(spark, docs, data)
    words = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert all(abs(words[s] - t) <= 10 for s, t in target.items())
    assert got.groupBy("doc_id", "text", "source").count().count() <= len(rows)


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_edges(spark, data, request, which):
    docs = request.getfixturevalue(which)
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, data)
        assert out.columns == (COLUMNS if k < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"])
        n = out.count()
        assert n <= 3 * docs.count() and (which == "edge" or n == 0)
