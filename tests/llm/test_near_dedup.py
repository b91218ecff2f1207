import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeflow.llm import near_dedup
from lodeflow.llm.components import components
from lodeflow.llm.near_dedup import _bands, _odd_sketch, _shingles, near_duplicates, op8_minmax_near_dedup


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        n = min(k, len(ws))
        out[i] = {tuple(ws[j : j + n]) for j in range(len(ws) - n + 1)} if ws else set()
    return out


def brute(rows, k, percent=80):
    """(component, set size) by comparing all pairs."""
    sets = shingle_sets(rows, k)
    ids, root = list(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    return {i: (find(i), len(sets[i])) for i in ids}


def result(df):
    return {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in df.collect()}


def copies(seed, groups, each, words, change):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{draw.randrange(400)}" for _ in range(words)]
        for _ in range(each):
            rows.append((len(rows), " ".join(w if draw.random() > change else f"n{draw.randrange(10**6)}" for w in base)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, k):
    rows = copies(k, 12, 9, 80, 0.03) + copies(k + 9, 1, 60, 90, 0.06)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k))
    assert got == brute(rows, k)


def test_edges(spark, edge, empty):
    out = near_duplicates(edge, k=2).collect()
    assert len(out) == edge.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert Counter(r["doc_id"] for r in out)[1] == 2
    for i in (3, 4, 5):
        assert (by[i]["n_shingles"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert by[9]["n_shingles"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (5, 5)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_components_of_shuffled_chains(spark):
    draw = random.Random(2)
    names = draw.sample(range(10**6), 3000)
    links = [(a, b) for chain in (names[:1500], sorted(names[1500:])) for a, b in zip(chain, chain[1:], strict=False)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: min(names[:1500]) for n in names[:1500]} | {n: min(names[1500:]) for n in names[1500:]}


def test_a_crowded_bucket_of_unlinked_texts(spark):
    """1,100 texts share all but a fifth of their words: similarities stay just under the limit, and a few links hide."""
    common = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(common + [f"t{i}w{j}" for j in range(25)])) for i in range(1100)]
    rows += [(2000 + i, rows[37 * i][1] + " more words") for i in range(20)]
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2))
    want = {i: i for i, _ in rows} | {2000 + i: 37 * i for i in range(20)}
    assert {i: c for i, (c, _) in got.items()} == want


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "n o p q r s t"), (2, "n o p q r s t"), (1, "a b c d e f g")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"], r["chosen"]) for r in out) == [(1, 1, True, True)] * 3 + [(2, 1, False, False)]
    assert len({r["group"] for r in out}) == 2


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    whole = draw.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.unique(whole[:1000]), np.unique(whole[200:])
    keys = _bands([a, b])
    assert (keys[0] == keys[1]).sum() <= near_dedup.BANDS
    apart = np.unpackbits((_odd_sketch(a) ^ _odd_sketch(b)).view(np.uint8)).sum()
    assert apart <= len(np.setxor1d(a, b))


def test_words_split_and_case():
    one, two = _shingles(["A b c".encode(), "a\tB c".encode()], 2)
    assert (one == two).all() and len(one) == 1


def test_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert result(op8_minmax_near_dedup(spark, data)) == brute(rows, 2)


def test_exact_misses_nothing(spark, monkeypatch, edge):
    """With one band of four places, bucketing misses links; the exact way finds them all."""
    whole = near_dedup.signatures
    monkeypatch.setattr(near_dedup, "signatures", lambda docs, k: whole(docs, k).withColumn("bands", F.slice("bands", 1, 1)))
    rows = copies(21, 20, 3, 14, 0.03) + copies(22, 60, 2, 60, 0.015)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert result(near_duplicates(df, k=2)) != want
    assert result(near_duplicates(df, k=2, exact=True)) == want
    plain = sorted(map(str, near_duplicates(edge, k=2).select("doc_id", "component_id", "kept").collect()))
    assert sorted(map(str, near_duplicates(edge, k=2, exact=True).select("doc_id", "component_id", "kept").collect())) == plain
