"""Language-model scores from a log-frequency Bloom filter, and an exact unigram base.

An n-gram's count is quantised to its length in bits and the first BITS bits after the leading one, so counts up to 2,047
are kept and larger ones are off by one part in 2,048 at most. The filter holds the pairs (n-gram, 1), ..., (n-gram,
length); a lookup probes one after another until one is missing. The bits behind are a path in a binary tree: a lookup
probes both ways at each step, and false ways soon end. No n-gram is lost, and false positives (about one unseen n-gram in
62 reads as seen once) rarely raise a count further.

Scores are of a normalised model. With q the quantised counts, S the sum of q(w) over the V words:

    P(w)     = (q(w) + 0.1) / (S + 0.1 (V + 1))
    P(w | v) = SHARE q(v w) / q(v) + (1 - SHARE) P(w)

and P(w) alone at a text's first word or after an unknown one. The bigrams of v occur as often as v does, so the masses
over all words and one unknown word add up to 1 within the quantisation, but for false positives.

An entry sets bits in two words of the filter, so a probe reads two places. The filter's size follows the number of its
entries. It is built in segments by tasks; an n-gram's probes stay in the segment that the upper half of its hash names.
So ordered n-grams go through the segments one after another, and each segment's part of them is one stretch.

Words and bigrams are counted in one pass: each run of texts sends a segment one row with its distinct n-grams and one with
their counts, and the segment adds these up. Up to FILTER_BYTES, all segments are broadcast to the workers. A larger filter
stays in its segments: the distinct n-grams of each run of texts go to the segments in one shuffle, and their counts come
back in another. Both ways give the same scores.

The base score needs each token's exact count: those of up to HEAD most frequent tokens go to the workers, the others'
come by a join with the table of all counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, mix, parts_of, pick, staged, utf8

FILTER_BYTES, SEGMENT_BYTES, BITS_EACH = 112 << 20, 2 << 20, 9.0
#: Bits that an entry sets in its first and in its second word.
PROBES = (3, 2)
#: Bytes of the filter that a byte of text makes, nearly; only the number of segments follows from it, not their sizes.
FILL = 0.2
BITS = 10
SHARE, ADD, HEAD = 0.4, 0.1, 300_000
END = b"\n"  # no word holds a line feed
#: Characters that are cut into words at once; tokens whose distinct n-grams are looked up together beside the whole filter, and
#: a quarter of those that go to the segments together; characters of texts that stay together where the filter stays in
#: its segments; n-grams that are probed at once.
CHUNK, TOKENS, PACK, SLICE = 600_000, 1 << 18, 12_000_000, 1 << 15
#: Rows of an Arrow batch where texts go to workers; 10,000, which is usual, would hold a task's whole texts three times.
BATCH_ROWS = 500
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


@contextmanager
def _small_batches(spark):
    """Arrow batches of BATCH_ROWS rows for the steps that are written meanwhile; the session's own setting comes back."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(setting, own)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens in a row, each text's end included, and how many each text has."""
    words = [[*t.lower().split(), END] for t in texts]
    return hashed([w for ws in words for w in ws]), np.array([len(ws) for ws in words], np.int64)


def _pairs(h: np.ndarray) -> np.ndarray:
    """The bigram hash at each token but the first."""
    return mix(h[:-1] * _K1 + h[1:])


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _inside(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where tokens in a row, of texts with n tokens each, have a token of their text before them."""
    out = np.ones(len(h), bool)
    out[np.cumsum(n) - n] = False
    return out


def _bigrams(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the bigrams of texts; none reaches over a text's end."""
    return _pairs(h)[_inside(h, n)[1:]]


def _runs(batches: Iterator[pd.DataFrame], tokens: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Runs of texts with about that many tokens: their other columns, the tokens' hashes, and how many each text has."""
    held: list[tuple] = []
    for part in parts_of(batches, CHUNK):
        held.append((part.drop(columns="text"), *_tokens([utf8(t) for t in part["text"]])))
        if sum(len(x[1]) for x in held) >= tokens:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    columns, h, n = zip(*held, strict=True)
    return pd.concat(columns, ignore_index=True), np.concatenate(h), np.concatenate(n)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).view(np.int64)


def _cuts(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where the parts of ordered n-grams begin that belong to the segments, and the end."""
    return np.searchsorted(_segment(keys, segments), np.arange(segments + 1))


def _counted_pairs(rows: np.ndarray, tokens: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct (row, token) pairs in order, and how often each occurs."""
    order = np.lexsort((tokens, rows))
    rows, tokens = rows[order], tokens[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])])) if len(rows) else np.empty(0, np.int64)
    return (rows[new], tokens[new]), np.diff(new, append=len(rows))


def counted(docs: DataFrame, segments: int) -> DataFrame:
    """text -> (segment, kind, keys, counts): the distinct words (kind 0) and bigrams (1) of runs of texts, and their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, h, n in _runs(batches, 4 * TOKENS):
            for kind, grams in enumerate((h, _bigrams(h, n))):
                keys, counts = np.unique(grams, return_counts=True)
                cuts, counts = _cuts(keys, segments), counts.astype("<u4")
                some = np.flatnonzero(np.diff(cuts))
                each = lambda x: [x[cuts[k] : cuts[k + 1]].tobytes() for k in some]  # noqa: B023, E731
                yield pd.DataFrame({"segment": some, "kind": kind, "keys": each(keys), "counts": each(counts)})

    return docs.select("text").mapInPandas(run, "segment int, kind int, keys binary, counts binary")


def _added(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a segment's rows in order, and their counts over all rows."""
    keys, n = np.frombuffer(b"".join(rows["keys"]), np.uint64), np.frombuffer(b"".join(rows["counts"]), "<u4").astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(n[order], new) if len(new) else n


def build_model(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, bits, words, counts, total, distinct, level_sum) of texts: a segment of the filter, with as many bytes as its
    entries take, and its words with their exact counts, with their sum, number and sum of quantised counts."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (words, counts), (pairs, more) = (_added(rows[rows["kind"] == kind]) for kind in (0, 1))
        grams, n = np.concatenate([words, pairs]), np.concatenate([counts, more])
        bits = build_segment(grams, n, int(entries(n).sum() * BITS_EACH / 8) + 1)
        return pd.DataFrame({"segment": [key[0]], "bits": [bits.tobytes()], "words": [words.tobytes()], "counts": [counts.tobytes()], "total": [counts.sum()], "distinct": [len(words)], "level_sum": [quantised(counts).sum()]})

    return counted(docs, segments).groupBy("segment").applyInPandas(fill, "segment int, bits binary, words binary, counts binary, total long, distinct long, level_sum double")


def unigram_counts(model: DataFrame) -> DataFrame:
    """(h, n): the exact count of each word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words, counts in zip(batch["words"], batch["counts"], strict=True):
                yield pd.DataFrame({"h": np.frombuffer(words, np.int64), "n": np.frombuffer(counts, np.int64)})

    return model.select("words", "counts").mapInPandas(run, "h long, n long")


def _most_frequent(counts: DataFrame) -> pd.DataFrame:
    """The tokens of the largest counts, HEAD at most. The least count that stays comes from a histogram of a few hundred
    rows, so that no more rows than these go to the driver."""
    step = F.floor(F.log(1.05, F.col("n")) + 1e-9)
    taken, cut = 0, None
    for level, size in sorted(counts.groupBy(step).count().collect(), reverse=True):
        if taken + size > HEAD:
            break
        taken, cut = taken + size, level
    return counts.where(step >= cut).toPandas() if taken else pd.DataFrame({"h": [], "n": []}).astype("int64")


def _length(n: np.ndarray) -> np.ndarray:
    """The length of a count in bits, less one."""
    return np.frexp(n.astype(float))[1].astype(np.int64) - 1


def quantised(n: np.ndarray) -> np.ndarray:
    step = 2.0 ** np.maximum(_length(n) - BITS, 0)
    return np.where(step > 1, (np.floor(n / step) + 0.5) * step, n)


def entries(n: np.ndarray) -> np.ndarray:
    """How many pairs the filter holds for a count."""
    return _length(n) + 1 + np.minimum(_length(n), BITS)


def _place(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Numbers below n from the upper half of hashes, without a division."""
    return (((x >> np.uint64(32)) * np.asarray(n, np.uint64)) >> np.uint64(32)).view(np.int64)


def _salted(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return mix(h + np.asarray(salt, np.uint64) * _K2)


def _again(x: np.ndarray) -> np.ndarray:
    """Another hash of salted n-grams: the first one names the first word and its bits, this one the second."""
    return mix(x ^ _K1)


def _bit(x: np.ndarray, i: int) -> np.ndarray:
    """The number of bit i that a hash sets in its word."""
    return (x >> np.uint64(6 * i)) & np.uint64(63)


def _branch(length: np.ndarray, depth: int, path: np.ndarray) -> np.ndarray:
    """The salt of the first `depth` bits after the leading one, of counts of a length."""
    salt = (np.uint64(1) << np.uint64(40)) + (length.astype(np.uint64) << np.uint64(32)) + (np.uint64(depth) << np.uint64(20))
    return salt + path.astype(np.uint64)


def build_segment(h: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The bytes of a segment that holds n-grams and their counts; size is rounded up to words of 8 bytes."""
    words = -(-size // 8)
    bits = np.zeros(words * 64, bool)

    def put(h: np.ndarray, salt: np.ndarray | int) -> None:
        x = _salted(h, salt)
        for hashes, probes in zip((x, _again(x)), PROBES, strict=True):
            begin = _place(hashes, words) << 6
            for i in range(probes):
                bits[begin + _bit(hashes, i).view(np.int64)] = True

    length = _length(n)
    for k in range(int(length.max(initial=-1)) + 1):
        put(h[length >= k], k + 1)
    for depth in range(1, BITS + 1):
        h, n, length = h[length >= depth], n[length >= depth], length[length >= depth]
        put(h, _branch(length, depth, (n >> (length - depth)) & ((1 << depth) - 1)))
    return np.packbits(bits, bitorder="little")


def build_filter(counts: DataFrame, segments: int, size: int) -> DataFrame:
    """(segment, bits) of an (h, n) table; a segment is the work of a task."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = build_segment(rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy(), size)
        return pd.DataFrame({"segment": [key[0]], "bits": [made.tobytes()]})

    segment = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(segments), 32).cast("int").alias("segment")
    return counts.select(segment, "h", "n").groupBy("segment").applyInPandas(fill, "segment int, bits binary")


class Filter:
    """Lookups in segments that stand in a row: of equal size, or of the given sizes in bytes."""

    def __init__(self, table: np.ndarray, segments: int, sizes: list[int] | None = None):
        self.table, self.segments = table.view("<u8"), segments
        self.words = np.array(sizes or [len(table) // segments] * segments, np.uint64) // np.uint64(8)
        self.begin = (np.cumsum(self.words) - self.words).view(np.int64)

    def holds(self, h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        """Whether the filter has salted n-grams. Two words are read; the second only where the first has all bits."""
        own = _segment(h, self.segments)
        words, begin, hashes, left = self.words[own], self.begin[own], _salted(h, salt), None
        for probes in PROBES:
            if left is not None:
                words, begin, hashes = words[left], begin[left], _again(hashes[left])
            found, hit = self.table[begin + _place(hashes, words)], np.uint64(1)
            for i in range(probes):
                hit = hit & (found >> _bit(hashes, i))
            there = np.flatnonzero(hit)
            left = there if left is None else left[there]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The quantised counts, 0 for n-grams that the filter lacks."""
        out = np.empty(len(h))
        for at in range(0, len(h), SLICE):
            out[at : at + SLICE] = self._counts(h[at : at + SLICE])
        return out

    def _counts(self, h: np.ndarray) -> np.ndarray:
        length, left = np.full(len(h), -1), np.arange(len(h))
        for k in range(62):
            left = left[self.holds(h[left], k + 1)]
            if not len(left):
                break
            length[left] = k
        out = np.where(length >= 0, 2.0 ** np.maximum(length, 0), 0.0)
        at = np.flatnonzero(length > 0)
        path = np.zeros(len(at), np.int64)
        for depth in range(1, BITS + 1):
            more = length[at] >= depth
            rest, known, at, path = at[~more], path[~more], np.repeat(at[more], 2), np.repeat(path[more], 2) * 2
            path[1::2] += 1
            kept = self.holds(h[at], _branch(length[at], depth, path))
            at, path = np.concatenate([rest, at[kept]]), np.concatenate([known, path[kept]])
        # of several ways that reach the end, of which one is true, any; a count with more bits is in the middle of its step
        bits = np.minimum(length[at], BITS)
        out[at] = ((1 << bits) + path + 0.5 * (length[at] > BITS)) * 2.0 ** (length[at] - bits)
        return out


def probabilities(pair: np.ndarray, before: np.ndarray, own: np.ndarray, floor: float) -> np.ndarray:
    """P(w | v) from q(v w), q(v) and q(w); where q(v) is 0, P(w). floor: S + 0.1 (V + 1)."""
    single = (own + ADD) / floor
    seen = np.where(own > 0, np.minimum(pair, before), 0.0)  # a bigram of an unknown word is a false positive
    return np.where(before > 0, SHARE * seen / np.maximum(before, 1.0) + (1 - SHARE) * single, single)


def _model_logs(h: np.ndarray, n: np.ndarray, own: np.ndarray, pair: np.ndarray, floor: float) -> np.ndarray:
    """log10 of the model's probability of each token, from q of each token and of the bigrams inside texts."""
    inside, before, joint = _inside(h, n), np.zeros(len(h)), np.zeros(len(h))
    before[inside] = own[:-1][inside[1:]]
    joint[inside] = pair
    return np.log10(probabilities(joint, before, own, floor))


SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>"


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ordered keys have each hash, and whether they have it."""
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)


def _scores(part: pd.DataFrame, h: np.ndarray, n: np.ndarray, known: tuple, look_up: Callable, floor: float, base_floor: float) -> pd.DataFrame:
    """SCORED of a run of texts: its (row, doc_id) and tokens. known: hashes and exact counts of the most frequent tokens, and
    whether these are all.

    look_up gives q of distinct tokens and of distinct bigrams, each in order: what a run repeats is probed once.
    """
    keys, values, complete = known
    starts, own = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    words, word = np.unique(h, return_inverse=True)
    pairs, pair = np.unique(_bigrams(h, n), return_inverse=True)
    at, there = _found(keys, words)
    c = (np.where(there, values[at], 0) if len(keys) else np.zeros(len(words), np.int64))[word]
    # tokens not among the most frequent ones: their counts come by the join
    rare = np.flatnonzero(c == 0) if not complete else np.empty(0, np.int64)
    logs = np.where((c > 0) | complete, np.log10((c + ADD) / base_floor), 0.0)
    r, k = _counted_pairs(own[rare], _signed(h)[rare])
    cuts = np.searchsorted(r[0], np.arange(len(n) + 1))
    each = lambda x: [x[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    of_words, of_pairs = look_up(words, pairs)
    model = _model_logs(h, n, of_words[word], of_pairs[pair], floor)
    sums = lambda x: np.add.reduceat(x, starts)
    return pd.DataFrame({"row": part["row"], "doc_id": part["doc_id"], "n_tokens": n, "n_known": sums((c > 0).astype(np.int64)), "base": sums(logs), "score": sums(model), "rare": each(r[1]), "times": each(k)})


def _broadcast_scores(rows: DataFrame, known: tuple, made: DataFrame, segments: int, floor: float, base_floor: float) -> DataFrame:
    """Scores with the whole filter on each worker; FILTER_BYTES at most pass through the driver."""
    # plain bytes: a worker then holds no second copy while it loads them
    parts = {r["segment"]: bytes(r["bits"]) for r in made.select("segment", "bits").toLocalIterator()}
    sizes = [len(parts.setdefault(k, bytes(8))) for k in range(segments)]
    shared = rows.sparkSession.sparkContext.broadcast((known, b"".join(parts.pop(k) for k in range(segments)), sizes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, table, sizes = shared.value
        found = Filter(np.frombuffer(table, np.uint8), segments, sizes)
        for part, h, n in _runs(batches, TOKENS):
            yield _scores(part, h, n, own, lambda *asked: [found.counts(x) for x in asked], floor, base_floor)

    return rows.mapInPandas(run, SCORED)


def _segment_scores(rows: DataFrame, known: tuple, made: DataFrame, segments: int, floor: float, base_floor: float) -> DataFrame:
    """The same scores with the filter in its segments: n-grams of runs of texts go there, counts come back.

    Texts are packed into chunks. Where a task reads only some of a chunk's texts, it asks for these; a run is known by its
    first row's number, so that its counts find the same texts again.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        for part in parts_of(batches, CHUNK):
            yield pd.DataFrame({"chunk": number, "row": part["row"], "doc_id": part["doc_id"], "text": part["text"]})
            size += sum(len(t) for t in part["text"] if isinstance(t, str))
            if size >= PACK:
                number, size = number + 1, 0

    with _small_batches(rows.sparkSession):
        chunks = staged(rows.mapInPandas(pack, "chunk long, row long, doc_id long, text string"), "chunks")

    def of_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Runs of texts, none over a chunk's end."""
        pieces = (piece for batch in batches for _, piece in batch.groupby("chunk", sort=False))
        for _, own in groupby(pieces, lambda piece: piece["chunk"].iloc[0]):
            yield from _runs(own, 4 * TOKENS)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, h, n in of_chunks(batches):
            words, pairs = np.unique(h), np.unique(_bigrams(h, n))
            of_words, of_pairs = _cuts(words, segments), _cuts(pairs, segments)
            some = np.flatnonzero(np.diff(of_words) + np.diff(of_pairs))
            keys = [words[of_words[k] : of_words[k + 1]].tobytes() + pairs[of_pairs[k] : of_pairs[k + 1]].tobytes() for k in some]
            yield pd.DataFrame({"segment": some, "chunk": part["chunk"].iloc[0], "run": part["row"].iloc[0], "words": np.diff(of_words)[some], "keys": keys})

    def answer(key: tuple, asked: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        found = Filter(np.frombuffer(bits["bits"].iloc[0] if len(bits) else bytes(8), np.uint8), 1)
        counts = [found.counts(np.frombuffer(k, np.uint64)).astype("<f4").tobytes() for k in asked["keys"]]
        return asked[["chunk", "run", "words"]].assign(segment=key[0], counts=counts)

    def score(key: tuple, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values("row", ignore_index=True), []
        told = {first: own.sort_values("segment") for first, own in found.groupby("run")}
        begins = np.searchsorted(part["row"], sorted(told))
        for first, begin, end in zip(sorted(told), begins, [*begins[1:], len(part)], strict=True):
            counts = [np.frombuffer(c, "<f4") for c in told[first]["counts"]]
            both = (np.concatenate([c[:w] for c, w in zip(counts, told[first]["words"], strict=True)]), np.concatenate([c[w:] for c, w in zip(counts, told[first]["words"], strict=True)]))
            run = _joined([(p.drop(columns="text"), *_tokens([utf8(t) for t in p["text"]])) for p in parts_of([part.iloc[begin:end]], CHUNK)])
            out.append(_scores(*run, shared.value, lambda *_, both=both: [x.astype(float) for x in both], floor, base_floor))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})

    with _small_batches(rows.sparkSession):
        asked = chunks.mapInPandas(ask, "segment int, chunk long, run long, words int, keys binary")
        told = asked.groupBy("segment").cogroup(made.select("segment", "bits").groupBy("segment")).applyInPandas(answer, "chunk long, run long, words int, segment int, counts binary")
        told = staged(told, "answers")
    rows.sparkSession._jvm.System.gc()
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(score, SCORED)


def score_documents(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, learning from training.

    Tokens are the words between ASCII white space, A-Z lower-cased, and an end for each text. Defined cases: a null or
    empty text has its end alone; repeated rows count and score each; n-grams of equal counts (ties) are treated alike; a
    very long text is a part of its own in one task; other columns, however named, are not read; with no training rows
    every count is 0, N is 0 and V is 0; an empty table gives no rows.
    """
    rows, learn = pick(docs, doc_id=id_col, text=text_col), pick(training, text=text_col)
    size = learn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(1, -(-int(size * FILL * BITS_EACH / 9) // SEGMENT_BYTES))
    with _small_batches(docs.sparkSession):
        made = staged(build_model(learn, segments), "model")
        counts = staged(unigram_counts(made), "unigrams")
    docs.sparkSession._jvm.System.gc()  # Spark deletes the shuffle files of steps that nothing refers to
    none = lambda name: F.coalesce(F.sum(name), F.lit(0))
    total, distinct, levels, held = made.agg(none("total"), none("distinct"), none("level_sum"), none(F.octet_length("bits"))).first()
    floor, base_floor = levels + ADD * (distinct + 1), total + ADD * (distinct + 1)
    head = _most_frequent(counts)
    top = head["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(top)
    known = (top[order], head["n"].to_numpy(np.int64)[order], distinct <= HEAD)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if held <= FILTER_BYTES:
        with _small_batches(docs.sparkSession):
            scored = staged(_broadcast_scores(numbered, known, made, segments, floor, base_floor), "scored")
    else:
        scored = staged(_segment_scores(numbered, known, made, segments, floor, base_floor), "scored")
    others = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("token"), F.col("t.times").alias("times"))
    found = others.join(counts, F.col("token") == F.col("h"), "left").withColumn("c", F.coalesce("n", F.lit(0)))
    log = F.log10((F.col("c") + ADD) / F.lit(base_floor)) * F.col("times")
    sums = found.groupBy(F.col("row").alias("r")).agg(F.sum(log).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("more"))
    out = scored.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(sums, F.col("row") == F.col("r"), "left")
    base = F.col("base") + F.coalesce("rest", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_log_frequency_bloom(spark, sf_dir):
    from .common import crc_mod, documents, table

    docs = documents(table(spark, sf_dir, "documents"))
    scored = score_documents(docs, docs.where(crc_mod("doc_id", 10) != 0))
    return scored.withColumn("held_out", crc_mod("doc_id", 10) == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
