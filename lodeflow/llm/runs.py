"""Periodic runs of words: a suffix automaton with small-to-large merging of ordered end-position sets.

A run is a stretch of consecutive words with smallest period q and a length of at least max(least, 2 * q) which no
neighbouring word extends keeping period q. The automaton's states form a tree by their suffix links; a state's set of end
positions is the union of its children's. Two end positions d apart that come from different children of a state agree on
exactly its length of words before them; if d is at most that length, they seed a square of period d, which starts where
the agreement does. Only pairs that become neighbours in a merge need a look: in a run with smallest period q, words q
apart never have an end position of the same state between them, since a primitive word isn't inside its own square. Each
merge walks the smaller set, so a text of n words costs n log n steps. A run's seeds share start and period and reach to
its last word, so the run is their union.

Before that, texts are cut down to what can hold a run: of its words, at least least / 2 in a row stand again q further
on in the same run. So each word of a run is in such a stretch of words that occurs twice there, and stretches between
words that aren't go to the automaton alone. Hashes only choose these stretches: a collision keeps too much, never too
little. Words themselves are told apart exactly.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick, portions

LEAST = 12
#: Bytes of text that a worker takes at once; a text over it is taken alone.
PORTION = 2_000_000
#: Narrowing ends when a round takes away less than this share of what is left.
WORTH = 0.05
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_DDL = "array<struct<start: bigint, length: bigint, period: bigint>>"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a sequence: each state's link, length, and own end position (-1 for clones and the root)."""
    step: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for at, w in enumerate(words):
        new = len(link)
        step.append({})
        length.append(at + 1)
        end.append(at)
        link.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                end.append(-1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = clone
                    p = link[p]
        last = new
    return link, length, end


def seeds(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) -> last word of the squares seeded there. Sets hold end positions negated: links mostly lead to
    earlier ones, which then go to a list's end."""
    link, length, end = automaton(words)
    sets: list[list[int] | None] = [None if e < 0 else [-e] for e in end]
    found: dict[tuple[int, int], int] = {}

    def seed(near: int, far: int, agree: int) -> None:
        # near and far are negated end positions, near < far, so the word at -far comes first
        if far - near <= agree:
            key = (1 - far - agree, far - near)
            if found.get(key, -1) < -near:
                found[key] = -near

    for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        u = link[v]
        own, sets[v] = sets[v], None
        if not u or not own:  # nothing agrees at the root
            continue
        big = sets[u]
        if big is None:
            sets[u] = own
            continue
        small = own
        if len(small) > len(big):
            small, big = big, small
        agree = length[u]
        if len(small) == 1:
            x = small[0]
            i = bisect_left(big, x)
            if i:
                seed(big[i - 1], x, agree)
            if i < len(big):
                seed(x, big[i], agree)
            big.insert(i, x)
        else:
            # only pairs of both sets are new; where two of the smaller one stay neighbours, they agree on more
            cuts = [bisect_left(big, x) for x in small]
            for k, (x, i) in enumerate(zip(small, cuts, strict=True)):
                if i and (not k or small[k - 1] < big[i - 1]):
                    seed(big[i - 1], x, agree)
                if i < len(big) and (k + 1 == len(small) or small[k + 1] > big[i]):
                    seed(x, big[i], agree)
            big.extend(small)
            big.sort()  # two ordered pieces: one merge
        sets[u] = big
    return found


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    at: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (start, period), last in seeds(words).items():
        at[start].append((period, last))
    out = []
    for start, own in at.items():
        kept: list[tuple[int, int]] = []
        for period, last in sorted(own):
            # a multiple of a smaller period over the same words is not their smallest
            if not any(period % p == 0 and e >= last for p, e in kept):
                kept.append((period, last))
                if last - start + 1 >= least:
                    out.append((start, last - start + 1, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, text_of: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that can hold runs, none across two texts."""
    gram = (least + 1) // 2
    n = len(ids)
    if n < 2 * gram:
        return []
    h = np.zeros(n - gram + 1, np.uint64)
    values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    for k in range(gram):
        h = h * np.uint64(0xD6E8FEB86659FD93) + values[k : n - gram + 1 + k]
    place = np.arange(n)
    part = text_of.astype(np.int64)  # the stretch of each word that is left
    while True:
        inside = np.flatnonzero((part[: len(place) - gram + 1] == part[gram - 1 :]) & (place[gram - 1 :] - place[: len(place) - gram + 1] == gram - 1)) if len(place) >= gram else np.empty(0, np.int64)
        key = h[place[inside]] ^ (part[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        same = key[order][1:] == key[order][:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(len(place) + 1, np.int64)
        np.add.at(edge, inside[again], 1)
        np.add.at(edge, inside[again] + gram, -1)
        left = np.cumsum(edge)[:-1] > 0
        before, place, part = len(place), place[left], part[left]
        if not len(place):
            return []
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 1) | (np.diff(part) != 0)]))
        part = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(place))))
        if len(place) > (1 - WORTH) * before:
            ends = np.append(begins[1:], len(place))
            return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(begins, ends, strict=True) if b - a >= least]


def _of_texts(texts: list[bytes | None], least: int) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text: its words' number, its runs, and the words that are left without repetitions, joined by spaces."""
    words = [(t or b"").split() for t in texts]
    sizes = np.array([len(ws) for ws in words], np.int64)
    first = np.cumsum(sizes) - sizes
    number = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(words)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for a, b in stretches(ids, text_of, least):
        k = int(text_of[a])
        runs[k] += [(a - int(first[k]) + s, n, q) for s, n, q in runs_of(ids[a:b].tolist(), least)]
    kept = []
    for ws, own in zip(words, runs, strict=True):
        own.sort(key=lambda r: (r[0], r[2]))
        if own:
            drop = np.zeros(len(ws) + 1, np.int64)
            for s, n, q in own:
                drop[s + q] += 1
                drop[s + n] -= 1
            ws = [w for w, d in zip(ws, np.cumsum(drop), strict=False) if not d]
        kept.append(b" ".join(ws))
    return sizes.tolist(), runs, kept


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: runs by start, then period; collapsed without the words that a run
    repeats, the others joined by one space.

    Words are what stands between the six ASCII white-space characters. Nothing is shuffled: a text is one row of one task.
    Defined cases: a null, empty or wordless text has no words, no runs and an empty collapsed text; a null doc_id and
    repeated rows each get a result of their own; runs of equal length (ties) are all listed; a very long text is taken
    whole, in memory of its own size times a constant; other columns, however named, are not read; an empty table gives
    none.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), PORTION):
                part = batch.slice(span.start, span.stop - span.start)
                sizes, runs, kept = _of_texts(part.column(1).to_pylist(), least)
                shown = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs], RUN)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), shown, pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS_DDL}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tails(doc_id: Column, text: Column) -> Column:
    """The texts that the query reads: of one id in ten, by crc32, the words from some place on repeat a stretch of words."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def edited(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
        at = lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), edited)).otherwise(text)


def op12_suffix_automaton_runs(spark, sf_dir):
    from .common import table

    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = periodic_runs(docs.select("doc_id", repeated_tails(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.withColumn("best", F.get(best, F.lit(0)))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
