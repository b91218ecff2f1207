import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeflow.llm import language_model as lm


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def base(rows, learn):
    counts = Counter(w for t in learn for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows]


@pytest.mark.parametrize("head", [300_000, 50])
def test_query(spark, data, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    kept = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    want = base(rows, [t for i, t in rows if kept(i)])
    got = lm.op9_log_frequency_bloom(spark, data).orderBy("doc_id").collect()
    for r, w in zip(got, want, strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and r["base_score"] == pytest.approx(w[4])
        assert r["held_out"] != kept(r["doc_id"]) and r["score"] < 0
    mean = lambda key: sum(r[key] for r in got) / sum(r["n_tokens"] for r in got)
    assert mean("score") > mean("base_score")


def test_filter(spark):
    draw = np.random.default_rng(5)
    h = np.unique(draw.integers(-(2**63), 2**63 - 1, 20_000))
    n = draw.zipf(1.6, len(h)).clip(1, 100_000)
    bits = lm.BITS_EACH * sum(int(c).bit_length() + min(int(c).bit_length() - 1, lm.BITS) for c in n)
    counts = spark.createDataFrame(list(zip(h.tolist(), n.tolist(), strict=True)), "h long, n long")
    made = sorted(lm.build_filter(counts, 3, int(bits / 24) + 1).collect(), key=lambda r: r["segment"])
    found = lm.Filter(np.concatenate([np.frombuffer(r["bits"], np.uint8) for r in made]), 3)
    seen = found.counts(h.view(np.uint64))
    exact = np.array([q(int(c)) for c in n])
    assert (seen > 0).all() and (np.abs(seen - exact) > 1e-6).mean() < 0.06  # few are changed
    assert np.abs(exact / n - 1).max() < 0.0006
    other = draw.integers(0, 2**63 - 1, 20_000).astype(np.uint64)
    assert (found.counts(other) > 0).mean() < 0.02


def test_edges(spark, edge, empty):
    out = lm.score_documents(edge, edge).collect()
    assert len(out) == 11 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert all(r["n_tokens"] == r["n_known"] == 1 for r in out if r["doc_id"] in (3, 4, 5))
    untaught = lm.score_documents(edge, empty).collect()
    assert len(untaught) == 11 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in untaught)
    assert lm.score_documents(empty, edge).count() == 0


def q(c):
    step = 1 << max(c.bit_length() - 11, 0)
    return float(c) if step == 1 else (c // step + 0.5) * step


class Model:
    """The probabilities from the counts of all words and bigrams, as the values of their levels."""

    def __init__(self, learn):
        self.words = Counter(w for t in learn for w in tokens(t))
        self.pairs = Counter(p for t in learn for p in zip(tokens(t), tokens(t)[1:], strict=False))
        self.floor = sum(map(q, self.words.values())) + 0.1 * (len(self.words) + 1)

    def p(self, w, v=None):
        single = (q(self.words[w]) + 0.1) / self.floor
        return 0.4 * q(self.pairs[v, w]) / q(self.words[v]) + 0.6 * single if v is not None and self.words[v] else single

    def score(self, text):
        ws = tokens(text)
        return sum(math.log10(self.p(w, v)) for v, w in zip([None, *ws], ws, strict=False))


def test_masses_add_up():
    draw = np.random.default_rng(4)
    learn = [" ".join(f"w{min(int(k), 300)}" for k in draw.zipf(1.4, 400)) for _ in range(40)]
    m = Model(learn)
    vocabulary = [*m.words, b"never seen"]
    assert sum(m.p(w) for w in vocabulary) == pytest.approx(1, abs=1e-9)
    for v in [w for w in vocabulary if w != b"\n"][:60]:
        own, pair = np.array([q(m.words[w]) for w in vocabulary]), np.array([q(m.pairs[v, w]) for w in vocabulary])
        got = lm.probabilities(pair, np.full(len(pair), q(m.words[v])), own, m.floor)
        assert got.sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("size", [96 << 20, 0])
def test_scores_against_exact_counts(spark, data, size, monkeypatch):
    """With the filter broadcast, and in its segments; it is thinly filled here, for few false positives."""
    monkeypatch.setattr(lm, "FILTER_BYTES", size)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 18)
    monkeypatch.setattr(lm, "BITS_EACH", 60.0)
    monkeypatch.setattr(lm, "CHUNK", 40_000)
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    m = Model([t for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0])
    got = {r["doc_id"]: r["score"] for r in lm.op9_log_frequency_bloom(spark, data).collect()}
    assert got == pytest.approx({i: m.score(t) for i, t in rows}, rel=1e-3)


def test_repeated_documents_stand_apart(spark, data):
    """A text that the corpus holds twice is far likelier, for its length, than one that was held out."""
    rows = lm.op9_log_frequency_bloom(spark, data).collect()
    per = lambda r: (r["score"] - r["base_score"]) / r["n_tokens"]
    out, learnt = ([per(r) for r in rows if r["held_out"] == h and r["n_tokens"] > 50] for h in (True, False))
    assert np.median(learnt) > np.median(out) + 0.5


def test_chunks_that_are_cut_by_batches_find_their_counts(spark, monkeypatch):
    """With the filter in its segments, a chunk's texts may reach a task in several batches."""
    monkeypatch.setattr(lm, "FILTER_BYTES", 0)
    monkeypatch.setattr(lm, "BATCH_ROWS", 7)
    monkeypatch.setattr(lm, "BITS_EACH", 60.0)
    monkeypatch.setattr(lm, "TOKENS", 20)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 10)
    texts = [" ".join(f"w{(i * j) % 41}" for j in range(i % 17)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    m = Model(texts)
    assert got == pytest.approx({i: m.score(t) for i, t in enumerate(texts)}, rel=1e-3)


def test_counting_sends_few_rows(spark, data):
    """What is shuffled is a row for each segment and run of texts, not one for each n-gram."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = docs.select("text").coalesce(1)
    rows = lm.counted(texts, 3).collect()
    words = Counter(w for r in docs.collect() for w in tokens(r["text"]))
    assert len(rows) == 6 and {r["kind"] for r in rows} == {0, 1}
    assert sum(sum(np.frombuffer(r["counts"], "<u4")) for r in rows if r["kind"] == 0) == sum(words.values())
