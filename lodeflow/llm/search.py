"""Ranked lexical search over a two-level quantised index.

A document's impact for a term is (10^9 * tf) div (1000 * tf + 20 * m) with m = 50 + (50 * n * N) div L, an integer under
10^6. The index holds, for blocks of documents (segments) and each of their terms, the documents with that term: on its
first level the impact divided by STEP and rounded up, one byte; on its second the exact frequency. A document's bytes,
times STEP and the terms' weights, add up to an upper bound of its score, and one less each to a lower bound. In each
segment the k-th largest lower bound of an item is one that its k best documents reach, so only documents whose upper bound
reaches it are rescored with exact integers; the best k of all segments are the item's result.

Words are told apart as they are, without hashes. A segment's postings are bounded (POSTINGS), so a frequent term's
documents stand in many segments.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, pick, portions, staged

#: Impacts under 10^6 in 255 steps: ceil(impact / STEP) fits a byte.
STEP, SCALE = 3922, 1_000_000_000
#: Words after which a segment is closed; one document more may enter. Bytes of text that a worker splits at once.
POSTINGS, PORTION = 2_000_000, 4_000_000
#: Items that are searched at once; more go in further passes over the index.
BLOCK = 4096
TOP = 50
#: Terms are runs of ASCII letters and digits and of bytes beyond ASCII; A-Z are lowered.
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
INDEX = "segment bigint, term string, places binary, impacts binary, tfs binary, ids array<bigint>"


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FORM).split()


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[slice, list[bytes | None]]]:
    for span in portions(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), PORTION):
        yield span, batch.column(at).slice(span.start, span.stop - span.start).to_pylist()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 20 * m)


def norms(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of n terms; in Python integers where 64 bits would not hold the product."""
    most = int(n.max()) if len(n) else 0
    if 50 * most * docs < 1 << 63:
        return 50 + (50 * n * docs) // max(words, 1)
    return np.array([50 + (50 * int(x) * docs) // max(words, 1) for x in n], np.int64)


class Index:
    """The written postings and the corpus' two numbers: documents with a term, and all terms with repeats."""

    def __init__(self, postings: DataFrame, docs: int, words: int):
        self.postings, self.docs, self.words = postings, docs, words

    def drop(self) -> None:
        discard(self.postings)


def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """Documents with a term, terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = words = 0
        for batch in batches:
            for _, texts in _texts(batch, batch.schema.get_field_index("text")):
                sizes = [len(terms(t)) for t in texts]
                docs, words = docs + sum(map(bool, sizes)), words + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], ["docs", "words"])

    r = rows.select("text").mapInArrow(run, "docs bigint, words bigint").agg(F.sum("docs"), F.sum("words")).first()
    return r[0] or 0, r[1] or 0


class _Segment:
    """Documents that are gathered until their words reach a bound, then turned into one row for each term."""

    def __init__(self):
        self.number, self.ids, self.sizes, self.words = defaultdict(count().__next__), [], [], []
        self.held = 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        number = self.number
        self.words.append(np.fromiter((number[w] for w in found), np.int32, len(found)))
        self.held += len(found)

    def rows(self, name: int, docs: int, words: int) -> Iterator[pa.RecordBatch]:
        n = np.array(self.sizes, np.int64)
        place = np.repeat(np.arange(len(n)), n)
        key, tf = np.unique(np.concatenate(self.words).astype(np.int64) * len(n) + place, return_counts=True)
        term, place = np.divmod(key, len(n))
        level = -(-impacts(tf.astype(np.int64), norms(n, docs, words)[place]) // STEP)
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        order = sorted(zip(self.number, range(len(begins)), strict=True))
        which = np.array([k for _, k in order])
        ends = np.append(begins[1:], len(term))
        columns = [(place.astype("<i4"), 4), (level.astype(np.uint8), 1), (tf.astype("<i4"), 4)]
        cut = [[v[a:b].tobytes() for a, b in zip(begins[which].tolist(), ends[which].tolist(), strict=True)] for v, _ in columns]
        head = pa.array([self.ids], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2, pa.array([norms(n, docs, words).astype("<i8").tobytes()], pa.binary()), head], ["segment", "term", "places", "impacts", "tfs", "ids"])
        for at in range(0, len(order), 5000):
            own = slice(at, at + 5000)
            names = pa.array([t for t, _ in order[own]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(names), pa.int64()), names.cast(pa.string()), *[pa.array(c[own], pa.binary()) for c in cut], pa.nulls(len(names), pa.list_(pa.int64()))], ["segment", "term", "places", "impacts", "tfs", "ids"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS) -> Index:
    """The index of all documents and all their terms, written to the shared folder. Texts are read twice: for the corpus'
    numbers, then for the postings. Nothing is shuffled.

    Rows: segment, term, places of documents in the segment, their impact bytes, their frequencies; one row of each segment
    has no term, and the ids and norms of its documents. Null, empty and wordless texts are in no segment.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    docs_n, words_n = corpus_size(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, made = _Segment(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for span, texts in _texts(batch, 1):
                for doc_id, text in zip(batch.column(0).slice(span.start, span.stop - span.start).to_pylist(), texts, strict=True):
                    if found := terms(text):
                        own.add(doc_id, found)
                    if own.held >= postings:
                        yield from own.rows(made, docs_n, words_n)
                        own, made = _Segment(), made + 1
        if own.held:
            yield from own.rows(made, docs_n, words_n)

    return Index(staged(rows.mapInArrow(run, INDEX), "index"), docs_n, words_n)


def _best(part: pd.DataFrame, k: int, tally: list[int] | None = None) -> pd.DataFrame:
    """One segment's k best documents of each item: bounds by bytes, exact scores of what can be among them."""
    head = part["term"].isna().to_numpy()
    ids = np.asarray(part["ids"].to_numpy()[head][0])
    norm = np.frombuffer(part["tfs"].to_numpy()[head][0], "<i8")
    part = part[~head]
    places = [np.frombuffer(b, "<i4") for b in part["places"]]
    levels, tfs = list(part["impacts"]), list(part["tfs"])
    weight = part["w"].to_numpy(np.int64)
    asked = defaultdict(list)
    for t, items in enumerate(part["items"]):
        for i in items:
            asked[int(i)].append(t)
    out = []
    for item, own in asked.items():
        at = np.concatenate([places[t] for t in own])
        many = [len(places[t]) for t in own]
        w = np.repeat(weight[own], many)
        byte = np.frombuffer(b"".join(levels[t] for t in own), np.uint8).astype(np.int64)
        here, slot = np.unique(at, return_inverse=True)
        upper, lower = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
        np.add.at(upper, slot, w * byte * STEP)
        np.add.at(lower, slot, w * (byte - 1) * STEP)
        reach = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else 0
        near = upper >= reach
        chosen = near[slot]
        tf = np.frombuffer(b"".join(tfs[t] for t in own), "<i4")[chosen].astype(np.int64)
        score = np.zeros(len(here), np.int64)
        np.add.at(score, slot[chosen], w[chosen] * impacts(tf, norm[at[chosen]]))
        kept = np.flatnonzero(near & (score > 0))
        if tally is not None:
            tally += [len(here), len(np.flatnonzero(near))]
        if not len(kept):
            continue
        doc = ids[here[kept]].astype(object)
        absent = np.array([d is None or d != d for d in doc])
        rank = np.lexsort((np.where(absent, 0, doc).astype(np.int64), absent, -score[kept]))[:k]
        out.append(pd.DataFrame({"item": item, "doc_id": pd.array([None if absent[r] else int(doc[r]) for r in rank], "Int64"), "score": score[kept][rank]}))
    return pd.concat(out) if out else pd.DataFrame({"item": [], "doc_id": [], "score": []})


def search(index: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(item, item_id, rank, doc_id, score): the k best documents of each item with a score over 0, equal scores by doc_id.

    item numbers the items' rows. Defined cases: an item without terms, or with none of the corpus, has no rows; items that
    share an id or a text (ties) are items of their own; documents that share an id too, null ids last; a very long item is
    one with many terms; other columns, however named, are not read; empty tables give none.
    """
    spark = items.sparkSession
    rows = pick(items, item_id=id_col, text=text_col)
    numbered = staged(_numbered(rows), "items")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span, texts in _texts(batch, 1):
                each = [sorted({*terms(t)}) for t in texts]
                item = np.repeat(batch.column(0).to_numpy()[span], [len(e) for e in each])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([t for e in each for t in e], pa.binary()).cast(pa.string())], ["item", "term"])

    asked = staged(numbered.select("item", F.col("text").cast("binary").alias("text")).mapInArrow(split, "item bigint, term string"), "terms")
    held = index.postings.where("term is not null").select(F.col("term").alias("t"), (F.octet_length("places") / 4).cast("long").alias("df"))
    df = held.join(asked.select("term").distinct(), F.col("t") == F.col("term"), "left_semi").groupBy("t").agg(F.sum("df").alias("df"))
    w = F.floor(F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1)) * 1000).cast("long")
    weights = staged(df.select("t", w.alias("w")).where("w > 0"), "weights")
    most = numbered.agg(F.max("item")).first()[0]
    found: DataFrame | None = None
    for first in range(0, (-1 if most is None else most) + 1, block):
        own = asked.where(F.col("item").between(first, first + block - 1)).join(weights, F.col("term") == F.col("t"))
        # at most `block` items; written, so that Spark knows its size and sends it to all workers where it is small
        own = staged(own.groupBy("t", "w").agg(F.collect_list("item").alias("items")), "asked")
        hits = index.postings.join(own, F.col("term") == F.col("t")).select("segment", "term", "places", "impacts", "tfs", "ids", "w", "items")
        heads = index.postings.where("term is null").select("segment", "term", "places", "impacts", "tfs", "ids", F.lit(None).cast("long").alias("w"), F.lit(None).cast("array<bigint>").alias("items"))
        best = staged(hits.union(heads).groupBy("segment").applyInPandas(lambda part: _best(part, k), "item bigint, doc_id bigint, score bigint"), "best")
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    names = numbered.select(F.col("item").alias("i"), "item_id")
    return ranked.join(names, F.col("item") == F.col("i")).select("item", "item_id", "rank", "doc_id", "score")


def _numbered(rows: DataFrame) -> DataFrame:
    """item, item_id, text: items numbered densely enough for blocks, in any order, without one task for all."""
    parts = rows.withColumn("at", F.monotonically_increasing_id())
    parts = staged(parts.select("item_id", "text", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")), "rows")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("part").alias("p"), before.alias("base"))  # one row for each input partition
    return parts.join(bases, F.col("part") == F.col("p")).select((F.col("base") + F.col("inside")).alias("item"), "item_id", "text")


def op13_two_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    index = build_index(table(spark, sf_dir, "documents"))
    out = staged(search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score"), "ranked")
    index.drop()
    return out


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])) AS ws FROM benchmark),
q AS (SELECT item, item_id, unnest(ws) AS term FROM i),
size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_words FROM d WHERE len(ws) > 0),
p AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), size),
s AS (SELECT q.item, q.item_id, p.r, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, size GROUP BY 1, 2, 3, 4),
t AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM t WHERE rank <= 50
"""
