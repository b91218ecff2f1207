import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeflow.llm import winnowing
from lodeflow.llm.winnowing import decontaminate, op5_winnowing_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for item, t in items:
        ws = words(t)
        n = min(10, len(ws))
        for k in range(len(ws) - n + 1) if ws else ():
            windows.setdefault((n, tuple(ws[k : k + n])), set()).add(item)
    out = []
    for i, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in {n for n, _ in windows}:
            for k in range(len(ws) - n + 1):
                if got := windows.get((n, tuple(ws[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(ws), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def run(spark, docs, items):
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in out.collect()), key=repr)


def case(seed):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("abcdefgh") * draw.choice((1, 2)) for _ in range(n))
    items = [(i, text(draw.choice((3, 9, 10, 14, 30)))) for i in range(12)] + [(12, ""), (13, None), (2, text(11)), (None, text(12))]
    docs = [(i, text(draw.choice((0, 2, 9, 12, 60)))) for i in range(30)]
    docs += [(100 + i, f"{text(20)} {draw.choice(items[:12])[1].upper()}, {text(5)}") for i in range(20)]
    return [*docs, docs[0], (None, items[3][1]), (200, None), (201, items[4][1])], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [200_000, 0])
def test_against_brute_force(spark, seed, small, monkeypatch):
    monkeypatch.setattr(winnowing, "SMALL", small)
    docs, items = case(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark, edge, empty):
    items = edge.where("false").select(F.col("row").alias("item_id"), F.lit("x").alias("text"))
    out = decontaminate(edge, items).collect()
    assert len(out) == 11 and all(r["n_hit"] == 0 and r["item_ids"] == [] for r in out)
    some = spark.createDataFrame([(1, "word0 word1 word2 word3 word4 word5 word6 word7 word8 word9")], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontaminate(edge, some).where("n_hit > 0").collect()) == ["1", "1", "2", "None"]
    assert decontaminate(empty, some).count() == 0


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = op5_winnowing_decontamination(spark, data).orderBy("doc_id").collect()
    want = sorted(brute(docs, items))
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in got] == [(i, n, h, hashlib.sha256(x.encode()).hexdigest()) for i, n, h, x in want]
    assert any(r["contaminated"] for r in got)
