"""Benchmark decontamination by winnowing, as DataFrame expressions.

Every text's k-gram hashes pass a sliding window of w; the minimum of each window is its fingerprint. Texts that share a
run of k + w - 1 words share that run's fingerprint, so with k + w - 1 = 10 no window of 10 item words can be missed. A
document's fingerprints are joined with the benchmark's; each one found is a place at which a window of 10 words may
stand, and its hash of all 10 words is then joined with the items' windows, which extends the hit word by word. Items
under 10 words have one window of their own length, matched without winnowing.

Texts are read once and never shuffled: what leaves a task is one row for each text and one for each fingerprint found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick, staged

#: k-grams, k-grams in a window, and the words that these cover: GRAM + WINDOW - 1. fingerprints() is made for these.
GRAM, WINDOW, SPAN = 5, 6, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints or windows of the benchmark that are sent to all workers; more go by a shuffled join.
SMALL = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _paired(a: Column, b: Column, shift: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(a[i], b[i + shift]), for each i at which both stand."""
    many = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), many), F.slice(b, F.lit(1 + shift), many), combine)


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _once(df: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """Add a column that is computed once for a row, however often later expressions name it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def hashed_words(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return _once(df, keep, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)), "hs")


def window_hashes(hashes: Column, width: int) -> Column:
    """The hash of each run of so many words."""
    many = F.greatest(F.size(hashes) - (width - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(hashes, F.lit(i + 1), many).alias(f"v{i}") for i in range(width)])
    return F.transform(runs, lambda s: F.xxhash64(F.lit(width), s))


def fingerprints(df: DataFrame, keep: list[str]) -> DataFrame:
    """hs -> ws: for each run of SPAN words, fp, the least hash of its k-grams, and win, the hash of the whole run.

    Hashes of pairs make those of four words, of five (GRAM) and of ten (SPAN); minima of two and four make those of six
    (WINDOW).
    """
    c = F.col
    df = _once(df, [*keep, "hs"], _paired(c("hs"), c("hs"), 1, _hash), "g2")
    df = _once(df, [*keep, "hs"], _paired(c("g2"), c("g2"), 2, _hash), "g4")
    df = _once(df, [*keep, "hs"], _paired(c("g4"), c("hs"), 4, _hash), "g5")
    df = _once(df, [*keep, "hs", "g5"], _paired(c("g5"), c("g5"), 1, _least), "m2")
    df = _once(df, [*keep, "hs", "g5", "m2"], _paired(c("m2"), c("m2"), 2, _least), "m4")
    return df.select(*keep, "hs", F.arrays_zip(_paired(c("m4"), c("m2"), 4, _least).alias("fp"), _paired(c("g5"), c("g5"), 5, _hash).alias("win")).alias("ws"))


def _windows(df: DataFrame, keep: list[str], short: list[int], alone: str | None = None) -> DataFrame:
    """keep, span, place, fp, win: a row for each window of SPAN words, or of as many as `short` says, in word hashes hs.

    With `alone`, a further row of span 0 for each text, whether or not it has a window; its fp is that column.
    """
    full = fingerprints(df, keep)
    kinds = [(0, F.array(F.struct(F.col(alone).alias("fp"), F.col(alone).alias("win"))))] if alone else []
    kinds += [(SPAN, F.col("ws")), *[(n, F.transform(window_hashes(F.col("hs"), n), lambda w: F.struct(w.alias("fp"), w.alias("win")))) for n in short]]
    each = full.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("span"), ws.alias("ws")) for n, ws in kinds])).alias("kind"))
    return each.select(*keep, F.col("kind.span").alias("span"), F.posexplode("kind.ws").alias("place", "w")).select(*keep, "span", "place", "w.fp", "w.win")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids) for each row of docs; item_ids sorted as strings.

    Defined cases: null and empty texts have no words; an item without words has no window; a null item_id marks words
    but is not listed; repeated rows each get a result; items that share an id count as one, items of equal text (ties)
    are all listed; a very long text is one row with as many windows as words; other columns, however named, are not
    read; empty tables give no hits, or no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    items = staged(hashed_words(pick(benchmark, item_id=item_col, text=item_text_col), ["item_id"]).where("size(hs) > 0"), "items")
    # at most 9 numbers: the lengths under 10 that items have
    short = sorted(r[0] for r in items.where(F.size("hs") < SPAN).select(F.size("hs").alias("n")).distinct().collect())
    own = _windows(items.withColumn("n", F.size("hs")), ["item_id", "n"], short)
    own = staged(own.where(F.col("span") == F.least("n", F.lit(SPAN))).select("item_id", F.col("span").alias("s"), F.col("fp").alias("known"), F.col("win").alias("wd")).distinct(), "windows")
    known = staged(own.select("known").distinct(), "fingerprints")
    near = F.broadcast if known.count() <= SMALL else lambda df: df
    near_windows = F.broadcast if own.count() <= SMALL else lambda df: df

    split = hashed_words(rows, ["row", "doc_id", "text_hash"]).withColumn("n_words", F.size("hs").cast("long"))
    keep = ["row", "doc_id", "text_hash", "n_words"]
    placed = _windows(split, keep, short, alone="row")
    marked = placed.join(near(known), F.col("fp") == F.col("known"), "left").where("span = 0 or known is not null")
    marked = staged(marked.select(*keep, "span", "place", "win"), "marked")

    hits = marked.where("span > 0").join(near_windows(own.select("item_id", "s", "wd").distinct()), (F.col("win") == F.col("wd")) & (F.col("span") == F.col("s")))
    per_row = hits.groupBy(F.col("row").alias("r")).agg(F.collect_set(F.struct("place", "span")).alias("places"), F.collect_set("item_id").alias("ids"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["place"], p["place"] + p["span"] - 1)))))
    per_row = per_row.select("r", covered.cast("long").alias("n_hit"), F.array_sort(F.transform("ids", lambda i: i.cast("string"))).alias("item_ids"))
    out = marked.where("span = 0").join(per_row, F.col("row") == F.col("r"), "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op5_winnowing_decontamination(spark, sf_dir):
    from .common import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS span, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda k: array_to_string(ws[k : k + least(10, len(ws)) - 1], ' '))) AS win FROM i WHERE len(ws) > 0),
spans AS (SELECT DISTINCT span FROM iw),
dw AS (SELECT doc_id, span, unnest(range(1, len(ws) - span + 2)) AS place, unnest(list_transform(range(1, len(ws) - span + 2), lambda k: array_to_string(ws[k : k + span - 1], ' '))) AS win FROM d, spans WHERE len(ws) >= span),
h AS (SELECT doc_id, place, dw.span, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.span = iw.span),
p AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(place, place + span)) AS w FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(q.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(q.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id
"""
