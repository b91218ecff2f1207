import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodeflow.llm import search as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(lowered)


def brute(docs, items, k=50):
    split = [(i, words(x)) for i, x in docs]
    n, total = sum(bool(ws) for _, ws in split), sum(len(ws) for _, ws in split)
    df = Counter(w for _, ws in split for w in set(ws))
    out = []
    for item_id, text in items:
        asked, scored = set(words(text)), []
        for i, ws in split:
            tf, norm = Counter(ws), 50 + 50 * len(ws) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * norm)) for w in asked if w in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item_id, r + 1, None if absent else i, -s) for r, (s, absent, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    for text in ("A-b_c9 É naïve\x00x\x7fy z☃", "", "  ", "don't 𝒳𝒴"):
        assert [t.decode() for t in m.terms(text.encode())] == words(text)
    assert m.terms(None) == []


def test_bytes_bound_impacts():
    rng = np.random.default_rng(1)
    tf, norm = rng.integers(1, 10**6, 10**5), rng.integers(50, 10**6, 10**5)
    exact = m.impacts(tf, norm)
    byte = -(-exact // m.STEP)
    assert exact.max() < 10**6 and byte.max() <= 255
    assert (byte * m.STEP >= exact).all() and ((byte - 1) * m.STEP < np.maximum(exact, 1)).all()
    assert m.norms(np.array([2**40]), 2**30, 2**60)[0] == 50 + 50 * 2**70 // 2**60


def test_query_equals_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = found(m.op13_two_level_search(spark, data))
    assert got == sorted(con.sql(m.OP13_SQL).fetchall(), key=str) and len(got) > 1000


@pytest.mark.parametrize(("postings", "block", "k"), [(300, 7, 3), (5000, 4096, 50), (1, 3, 10)])
def test_segments_and_blocks(spark, data, postings, block, k):
    """Many segments and blocks of items give the same result as brute force."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").limit(20).collect()]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    index = m.build_index(d, postings=postings)
    assert found(m.search(index, q, k=k, block=block)) == brute(docs, items, k)
    index.drop()


def test_few_are_rescored(spark, data):
    """Bounds leave out most documents: what is rescored is a small part of what shares a term."""
    import pandas as pd

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = m.build_index(d)
    text = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    asked = {w for w in words(text)}
    part = index.postings.toPandas()
    part = part[part["term"].isna() | part["term"].isin(asked)].copy()
    part["w"], part["items"] = 1000, [[0]] * len(part)
    tally = []
    best = m._best(part, 5, tally)
    assert isinstance(best, pd.DataFrame) and len(best) == 5 and tally[1] < tally[0] / 3


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "word1 word2 w3x3", "x"), (1, "WORD1 word2 w3x3", "x"), (None, "café naïve", "y"), (4, None, "z"), (5, "", "z"), (6, "absent", "z")], "item_id long, text string, rank string")
    index = m.build_index(edge)
    got = found(m.search(index, items))
    docs = [tuple(r) for r in edge.toDF(*[f"c{i}" for i in range(len(edge.columns))]).select("c0", "c1").collect()]
    assert got == brute(docs, [tuple(r)[:2] for r in items.collect()])
    assert {r[0] for r in got} == {1, None}
    assert m.search(index, items.limit(0)).count() == 0
    none = m.build_index(empty)
    assert m.search(none, items).count() == 0


def test_long_text_and_hot_term(spark):
    """One text over 1 MB, and a term that nearly all documents share, over several segments."""
    docs = [(0, "common " + " ".join(f"w{i % 5000}" for i in range(200_000)))] + [(i, f"common w{i % 7} x{i}") for i in range(1, 3000)]
    items = [(1, "common w3 x77"), (2, "x5")]
    index = m.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), postings=4000)
    assert found(m.search(index, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)
