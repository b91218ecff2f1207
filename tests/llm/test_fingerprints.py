import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodeflow.llm import fingerprints
from lodeflow.llm.fingerprints import edited_texts, fingerprint_edits, op2_weighted_sampling


def edited(texts):
    out = []
    for k, t in enumerate(texts):
        half, after = len(t) // 2, texts[(k + 1) % len(texts)]
        out.append(t[: len(t) - half] + after[:half])
    return out


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_query(spark, data):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    texts = [t for _, t in docs]
    other = edited(texts)
    got = op2_weighted_sampling(spark, data).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in docs] and [r["n_chars"] for r in got] == [len(t) for t in texts]
    assert [r["edited_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in other]
    near = np.array([(jaccard(t, e), r["near_edited"]) for t, e, r in zip(texts, other, got, strict=True)])
    after = np.array([(jaccard(t, texts[(k + 1) % len(texts)]), r["near_next"]) for k, (t, r) in enumerate(zip(texts, got, strict=True))])
    for pairs in (near, after):
        assert np.sqrt(((pairs[:, 0] - pairs[:, 1]) ** 2).mean()) < 0.1 and abs((pairs[:, 0] - pairs[:, 1]).mean()) < 0.05
    prints = {}
    for t, r in zip(texts, got, strict=True):
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_sparse_ids_and_groups(spark):
    ids = [-70, -1, 0, 5, 63, 64, 10_000, 9_000_000, 2**61]
    rows = [(i, f"text {k} " * (k + 1)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    got = edited_texts(df).orderBy("doc_id").collect()
    assert [r["edited"] for r in got] == edited([t for _, t in rows])


def test_edges(spark, edge, empty):
    out = fingerprint_edits(edge).collect()
    assert len(out) == 11 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[3]["n_chars"] == 0 and by[3]["fingerprint"] == "" and by[3]["near_next"] == 1.0
    ones = [r for r in out if r["doc_id"] == 1]
    assert len(ones) == 2 and ones[0]["fingerprint"] == ones[1]["fingerprint"] and max(r["near_next"] for r in ones) == 1.0
    assert fingerprint_edits(empty).count() == 0
    lone = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fingerprint_edits(lone).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_samples_agree_as_generalised_jaccard_says(spark):
    """Counts from 1 to 200. In one block of 128 samples, the rate of agreement; in 8 blocks of 16, the joint estimate."""
    draw = np.random.default_rng(5)
    count = lambda: np.maximum(1, draw.geometric(0.03, 60)).clip(max=200)
    bags = [dict(zip(draw.choice(90, 60, replace=False).tolist(), count().tolist(), strict=True)) for _ in range(8)]
    bags += [{w: max(1, n + int(draw.integers(-3, 4))) for w, n in b.items()} for b in bags]
    texts = [" ".join(f"w{w}" for w, n in b.items() for _ in range(n)) for b in bags]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    truth = np.array([jaccard(texts[i], texts[j]) for i, j in pairs])
    codes = F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(16)])
    blocks = F.collect_list(F.struct("block", "weight", codes.alias("codes")))
    whole = fingerprints.fingerprint(rows, ["id"], []).groupBy("id").agg(fingerprints.as_print(blocks).alias("p"))
    both = whole.toDF("i", "p").crossJoin(whole.toDF("j", "q")).where("i > j")
    got = {(r["i"], r["j"]): r["s"] for r in both.select("i", "j", fingerprints.likeness(F.col("p"), F.col("q")).alias("s")).collect()}
    off = np.array([got[p] for p in pairs]) - truth
    assert np.sqrt((off**2).mean()) < 0.06 and abs(off.mean()) < 0.02
    rates = {r["id"]: np.array([r[f"s{i}"] & 0xFFFFFFFF for i in range(128)]) for r in fingerprints.fingerprint(rows, ["id"], [], blocks=1, samples=128).collect()}
    off = np.array([(rates[i] == rates[j]).mean() for i, j in pairs]) - truth
    assert np.abs(off).max() < 0.17 and abs(off.mean()) < 0.01


def test_no_python_in_the_plan(spark, data):
    plan = op2_weighted_sampling(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_one_block(spark):
    """blocks=1: the rate at which the printed samples agree is the estimate, and near the generalised Jaccard similarity."""
    draw = np.random.default_rng(8)
    texts = [" ".join(f"w{w}" for w in draw.integers(0, 60, 120)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fingerprint_edits(df, blocks=1, samples=64).orderBy("doc_id").collect()
    codes = lambda p: [p.split("-")[1][k : k + 4] for k in range(0, 256, 4)]
    for t, e, r in zip(texts, edited(texts), got, strict=True):
        s = np.mean([x == y for x, y in zip(codes(r["fingerprint"]), codes(r["edited_fingerprint"]), strict=True)])
        assert abs(r["near_edited"] - s) < 1e-9 and abs(s - jaccard(t, e)) < 0.3
