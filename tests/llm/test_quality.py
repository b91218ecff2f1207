import zlib

import numpy as np
import pytest

from lodeflow.llm.quality import fit, keep_good, op1_zstd_quality, score_quality


def auc(score, label):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_held_out_documents(spark, larger):
    got = op1_zstd_quality(spark, larger).toPandas()
    docs = spark.read.parquet(f"{larger}/documents.parquet").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    marked = got[got["held_out"]].merge(spark.read.parquet(f"{larger}/labels.parquet").toPandas(), on="doc_id")
    assert auc(marked["score"].to_numpy(), marked["quality"].to_numpy()) > 0.8
    assert (marked["predicted"] == marked["quality"]).mean() > 0.9


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (9, 2)], "doc_id long, quality int")
    model = fit(edge, labels)
    out = score_quality(edge, model).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    assert score_quality(empty, model).count() == 0
    assert 0 <= fit(empty, labels.limit(0)).score([b""])[0] <= 1


def test_filter_keeps_all_columns(edge):
    from lodeflow.llm.quality import FEATURES, Compressors

    yes = Compressors(b"neutral text ", b"neutral text ", np.zeros(FEATURES), np.ones(FEATURES), np.array([5.0, *[0.0] * FEATURES]))
    out = keep_good(edge, yes)
    assert out.columns == edge.columns and out.count() == 11
    yes.weights = -yes.weights
    assert keep_good(edge, yes).count() == 0


def test_learning_separates(spark):
    good = [(i, " ".join(f"river stone meadow {i % 7} lantern {k}" for k in range(30)), 1) for i in range(40)]
    bad = [(100 + i, " ".join(f"BUY!! NOW!! {k}$$$" for k in range(40)), 0) for i in range(40)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    scores = {r["doc_id"]: r["score"] for r in score_quality(df, fit(df, df)).collect()}
    assert min(scores[i] for i, *_ in good) > max(scores[i] for i, *_ in bad)


def test_learns_from_whole_texts(spark):
    """What tells the classes apart stands behind the first 8,000 characters."""
    same = " ".join(f"plain opening {k % 50} line" for k in range(700))
    good = [(i, same + " ".join(f"river stone meadow {i % 7} lantern {k}" for k in range(700)), 1) for i in range(30)]
    bad = [(100 + i, same + " ".join(f"BUY!! NOW!! {k}$$$" for k in range(1500)), 0) for i in range(30)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    scores = {r["doc_id"]: r["score"] for r in score_quality(df, fit(df, df)).collect()}
    assert min(scores[i] for i, *_ in good) > 0.5 > max(scores[i] for i, *_ in bad)


def test_all_of_a_long_text_teaches(spark):
    """One document a class holds, behind a million characters, what tells the classes apart; no piece of it is out of reach."""
    same = " ".join(f"plain opening {k % 50} line" for k in range(50_000))
    good = [(i, (same if i == 0 else "") + " ".join(f"river stone meadow {i % 7} lantern {k}" for k in range(40)), 1) for i in range(30)]
    bad = [(100 + i, (same if i == 0 else "") + " ".join(f"BUY!! NOW!! {k}$$$" for k in range(60)), 0) for i in range(30)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    scores = {r["doc_id"]: r["score"] for r in score_quality(df, fit(df, df)).collect()}
    assert min(scores[i] for i, *_ in good[1:]) > 0.5 > max(scores[i] for i, *_ in bad[1:])


def test_dictionaries_matter(spark, larger):
    """Without dictionaries that tell the classes apart, the same calibration orders held-out documents worse."""
    from lodeflow.llm import quality
    from lodeflow.llm.common import crc_mod

    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    learned, held = (labels.where(crc_mod("doc_id", 5) != 0), labels.where(crc_mod("doc_id", 5) == 0).toPandas())
    model = fit(docs, learned)
    own = quality._dictionary
    quality._dictionary = lambda pieces: b"neutral text "
    try:
        blind = fit(docs, learned)
    finally:
        quality._dictionary = own
    assert blind.good == blind.bad == b"neutral text " and model.good != model.bad
    found = [score_quality(docs, m).toPandas().merge(held, on="doc_id") for m in (model, blind)]
    areas = [auc(f["score"].to_numpy(), f["quality"].to_numpy()) for f in found]
    print(areas)
    assert areas[0] > 0.9 and areas[0] >= areas[1]
