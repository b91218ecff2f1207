"""Quality scores by compression: zstandard dictionaries of good and of bad text, and what each saves.

A text is cut into pieces of PIECE bytes. Each is compressed under the good and under the bad dictionary; the
normalised difference of the sizes, (bad - good) / (bad + good), over the text and over its pieces, and the compression
ratios become a score by a logistic calibration fitted on labelled documents which the dictionaries have not seen.

Labelled documents come as a bounded sample (the first PER_CLASS documents of each label by a hash of their id). All pieces
of half of them are candidates for the dictionaries, and PIECES of each label are taken by a hash, from any place of any
text alike; the calibration uses the features of the other half's whole texts, computed inside tasks. Every document is
scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, parts_of, pick, portions, ship, utf8

PIECE, DICTIONARY, LEVEL = 512, 112 << 10, 3
FEATURES = 15
PER_CLASS, PIECES = 1500, 12_000


@dataclass
class Compressors:
    """What the workers need: two dictionaries, and the calibration's centre, scale and weights."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, texts: list[bytes]) -> np.ndarray:
        return _features(texts, self.good, self.bad)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights, -30, 30)))


def _features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """For each text: the normalised difference over all pieces, its least, largest and mean value over pieces, the ratios
    under both dictionaries and without one, the log of the length; and some products of these."""
    import zstandard

    tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (good, bad)]
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    out = np.zeros((len(texts), 8))
    for k, text in enumerate(texts):
        g = b = 1.0
        each = []
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            own = [len(t.compress(piece)) for t in tools]
            g, b = g + own[0], b + own[1]
            if len(piece) >= min(200, len(text)):  # a short rest says little by itself
                each.append((own[1] - own[0]) / (own[1] + own[0]))
        n, each = len(text) + 1, each or [0.0]
        out[k] = (b - g) / (b + g), g / n, b / n, np.log(n), min(each), max(each), len(plain.compress(text)) / n, sum(each) / len(each)
    diff, ratio, _, length, least, _, free, _ = out.T
    return np.column_stack([out, diff**2, ratio**2, diff * length, free**2, free * length, least**2, length**2])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps, classes weighted as they come, with a small ridge."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (y - p) - 0.1 * w)
    return centre, scale, w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, pieces: int = PIECES) -> Compressors:
    """Dictionaries from half of a bounded sample of labelled documents, calibration on the other half.

    Bounds: per_class documents of each label, pieces of PIECE bytes of each label. Null and empty texts have no pieces; of
    rows that share an id the calibration takes one, the one with the least features (ties), and an id with two labels counts
    as good; other columns are not read.
    Nothing learnt (no labelled rows, or of one class only): empty dictionaries are not possible, so a fixed neutral text
    stands in, and the score is the labels' mean (0.5 without any).
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    marks = pick(labels, own=id_col, label=label_col).where("label in (0, 1)").groupBy("own").agg(F.max("label").alias("label"))
    # the sample is chosen by ids alone; texts join afterwards, for chosen rows only
    ids = rows.select("doc_id").join(marks, F.col("doc_id") == F.col("own")).select("own", "label").dropDuplicates(["own"])
    counts = dict(ids.groupBy("label").count().collect())
    chosen, h = None, F.xxhash64("own", F.lit(1))
    for label in (0, 1):
        # more than enough pass by their hashes, so that few rows leave each task
        share = min(1.0, (2 * per_class + 500) / max(1, counts.get(label, 0)))
        top = ids.where((F.col("label") == label) & (F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30)))).orderBy(h, "own").limit(per_class)
        chosen = top if chosen is None else chosen.union(top)
    # each label's documents teach and calibrate in turn, in the order of their ids; at most per_class rows a window
    chosen = chosen.withColumn("half", F.row_number().over(Window.partitionBy("label").orderBy("own")) % 2)
    sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("own")).select("doc_id", "label", "half", F.coalesce("text", F.lit("")).alias("text"))

    teaches = F.col("half") == 1

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_of(batches, 2_000_000):
            for label, text in zip(part["label"], part["text"], strict=True):
                raw = utf8(text)
                own = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
                yield pd.DataFrame({"label": np.full(len(own), label), "piece": own})

    cuts = sample.where(teaches).mapInPandas(cut, sample.select("label", F.lit(b"").alias("piece")).schema)
    own = F.xxhash64("piece", F.lit(3))
    # top rows by a hash: each task sends pieces of them, at most
    taken = {k: [bytes(r["piece"]) for r in cuts.where(F.col("label") == k).orderBy(own, "piece").limit(pieces).collect()] for k in (1, 0)}
    sizes = dict(sample.where(~teaches).groupBy("label").agg(F.count_distinct("doc_id")).collect())
    if any(not taken[k] or sizes.get(k, 0) < 2 for k in (0, 1)):
        n = sum(counts.values())
        p = min(max(counts.get(1, 0) / n if n else 0.5, 0.01), 0.99)
        return Compressors(b"neutral text ", b"neutral text ", np.zeros(FEATURES), np.ones(FEATURES), np.array([np.log(p / (1 - p)), *[0.0] * FEATURES]))
    dictionaries = [_dictionary(taken[k]) for k in (1, 0)]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_of(batches, 2_000_000):
            x = _features([utf8(t) for t in part["text"]], *shared.value)
            yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "x": list(x)})

    schema = sample.select("doc_id", "label", F.array(F.lit(0.0)).alias("x")).schema
    measured = sample.where(~teaches).mapInPandas(measure, schema).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    truth = measured["label"].to_numpy(float)
    centre, scale, w = _calibrate(np.stack(measured["x"].to_list()), truth)
    # the sample is balanced by class: move the intercept to the classes' shares among all labelled rows
    w[0] += np.log(counts.get(1, 1) / counts.get(0, 1)) - np.log(truth.sum() / (len(truth) - truth.sum()))
    return Compressors(*dictionaries, centre, scale, w)


def _dictionary(pieces: list[bytes]) -> bytes:
    """DICTIONARY bytes of dictionary content: what zstandard's trainer finds, or the pieces themselves if they are few."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, [p for p in pieces if len(p) > 7]).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY:] or b"neutral text "


def score_quality(docs: DataFrame, model: Compressors, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row. A null or empty text is scored as one without pieces; repeated rows and equal texts
    (ties) have equal scores; a very long text is scored whole, in pieces; other columns, however named, are not read; an
    empty table gives none."""
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_of(batches, 2_000_000):
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": model.score([utf8(t) for t in part["text"]])})

    return rows.mapInPandas(run, rows.select("doc_id", F.lit(0.0).alias("score")).schema)


def keep_good(docs: DataFrame, model: Compressors, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least the given one; decided where the rows stand, without a shuffle.

    Null and empty texts are scored as texts without pieces; repeated rows and ties are all kept or all go; a very long text
    is scored whole; columns may share names; an empty table gives none."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            for span in portions(sizes, 2_000_000):
                part = batch.slice(span.start, span.stop - span.start)
                yield part.filter(pa.array(model.score([utf8(t) for t in part.column(at).to_pylist()]) >= least))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op1_zstd_quality(spark, sf_dir):
    from .common import documents, table

    docs = documents(table(spark, sf_dir, "documents"))
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    model = fit(docs.where(crc_mod("doc_id", 5) != 0), labels.where(crc_mod("doc_id", 5) != 0))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
