import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodeflow.llm import runs as m


def brute(w, least=12):
    """All maximal stretches of each period, the smallest period of each stretch."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def edited(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i if i < a else a + (i - a) % p] for i in range(n)]


def sequences():
    rng = random.Random(5)
    for _ in range(600):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(70)
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 2 + 1)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        yield w
    a, b = [0], [0, 1]  # a word with many overlapping runs
    while len(b) < 400:
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    for w in sequences():
        assert m.runs_of(w, least) == brute(w, least)


def test_narrowing_loses_nothing():
    every = [w for w in sequences() if len(w) < 71]
    texts = [b" ".join(b"%d" % x for x in w) for w in every]
    sizes, runs, kept = m._of_texts(texts, 12)
    assert sizes == [len(w) for w in every]
    assert runs == [brute(w) for w in every] and sum(map(bool, runs)) > 50
    for w, own, left in zip(every, runs, kept, strict=True):
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        assert left.split() == [b"%d" % x for i, x in enumerate(w) if i not in gone]


def test_automaton_knows_every_end_position():
    w = [random.Random(2).randrange(3) for _ in range(60)]
    link, length, end = m.automaton(w)
    below = [[] for _ in link]
    for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        below[v] += [end[v]] if end[v] >= 0 else []
        if link[v] > 0:
            below[link[v]] += below[v]
        longest = w[min(below[v]) - length[v] + 1 : min(below[v]) + 1]
        assert sorted(below[v]) == [e for e in range(len(w)) if e + 1 >= length[v] and w[e - length[v] + 1 : e + 1] == longest]


def test_query(spark, data):
    got = {r["doc_id"]: r for r in m.op12_suffix_automaton_runs(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ws = edited(d["doc_id"], (d["text"] or "").encode().split())
        own, r = brute(ws), got[d["doc_id"]]
        best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(own), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if own else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 10


def test_edges(spark, edge, empty):
    got = m.periodic_runs(edge).collect()
    assert len(got) == 11
    assert [r["n_words"] for r in got if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]
    assert all(r["runs"] == [] and r["collapsed"] == "" for r in got if not r["n_words"])
    (ten,) = (r for r in got if r["doc_id"] == 10)
    assert [tuple(x) for x in ten["runs"]] == [(0, 20, 4)] and ten["collapsed"] == "naïve ☃ 𝒳 café"
    assert m.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        m.periodic_runs(edge, least=1)


def test_long_texts(spark):
    """Over 1 MB: a period of 20,000 words, one word repeated, no repetition."""
    texts = [" ".join(f"w{i % 20000}" for i in range(150_000)), "a " * 600_000, " ".join(f"w{i}" for i in range(150_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.periodic_runs(df).withColumn("n", F.length("collapsed")).collect()}
    assert [[tuple(x) for x in got[i]["runs"]] for i in range(3)] == [[(0, 150_000, 20_000)], [(0, 600_000, 1)], []]
    assert got[1]["collapsed"] == "a" and got[2]["collapsed"] == texts[2]
