"""Token ids in files coded by a static range asymmetric numeral system (rANS).

Documents are put in ascending doc_id order by a range shuffle of their texts; each task then tokenises its range and
codes it in frames of up to FRAME tokens (a longer document makes a longer frame). A frame holds one frequency table,
shared by its blocks. Each block is coded apart from all others by interleaved coder states (lanes), and keeps a CRC of
its ids and checkpoints (all lanes' states and the place in the word stream), from which decoding can start.

The file is a Parquet table with a row for each frame, so Spark's readers and writers place and commit it.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, portions, remove, shared_path, staged

SCALE, LANES, BLOCK, FRAME, EVERY = 20, 4096, 1 << 20, 1 << 21, 128
CACHED = 500_000
#: Characters which are cut into pieces at once.
CHUNK = 2_000_000
#: What keeps a text from being cut at its spaces: white space before a space, or characters which Unicode versions may
#: class differently. ODD: the white space of one byte besides space and line feed, and controls that some count as such.
WHOLE = re.compile("\\s |[^\\x00-\\x1b\\x20-\\x84\\x86-\u024f]")
#: Fixed value: the splitting pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that stand for bytes in such a vocabulary: printable ones for themselves, the others from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b if b in PLAIN else 256 + sum(c not in PLAIN for c in range(b)) for b in range(256)}
#: Marks that are one unit of the splitting rule where they end a piece, after letters.
MARKS = ".,;:!?"
ODD = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
FRAME_SCHEMA = (
    "part int, frame int, n_tokens long, doc_ids array<long>, lengths array<long>, symbols binary, frequencies binary, "
    "blocks array<struct<n_tokens: int, crc: long, words: binary, places: array<int>, states: array<binary>>>"
)


class Known(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self[key] = self.make(key)
        return got

    def cut(self, most: int) -> None:
        """Forget what came after the first `most`."""
        for _ in range(len(self) - most):
            self.popitem()


class Pieces:
    """Ids of texts by the tokenizers library, which sees each distinct piece of the usual texts once while it is kept.

    The byte-level splitting rule never joins a non-space with a space after it. So a text can be cut before each space
    that follows a non-space, and its ids are those of the pieces in a row. A text with other spaces, or one that holds
    the string of an added token (such as <|endoftext|>, which has an id of its own then), is encoded whole; so are all
    texts if the tokenizer's file has another splitting rule, a normalizer, or a model that isn't plain byte-level BPE.
    """

    kept: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        first, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = first.get("type") == "ByteLevel" and not first["add_prefix_space"] and first.get("use_regex", True) and spec["normalizer"] is None
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        self.cuts = bool(plain and model["type"] == "BPE" and not any(model.get(k) for k in odd))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.split = regex.compile(PATTERN).findall
        self.known, self.units, self.first = Known(self._piece), Known(self._merged), Known(lambda text: self._plain(text).tobytes())

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _merged(self, unit: str) -> bytes:
        """The ids of one unit of the splitting rule, by the library's model alone."""
        if unit.isascii() and unit.isprintable():
            shown = unit.replace(" ", "\u0120")
        else:
            shown = unit.encode().decode("latin-1").translate(BYTES)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that stands after a space; a word's also serve for it with marks behind."""
        if piece.isalpha():
            return self._merged(f" {piece}")
        word = piece.rstrip(MARKS)
        if word.isalpha():
            return self.known[word] + self.units[piece[len(word) :]]
        return b"".join([self.known[u[1:]] if u[0] == " " and u[1:].isalpha() else self.units[u] for u in self.split(f" {piece}")])

    def _fits(self, text: str) -> bool:
        if not self.cuts or self.added(text):
            return False
        try:
            b = text.encode("latin-1")
        except UnicodeEncodeError:
            return not WHOLE.search(text)
        if len(b.translate(None, ODD)) != len(b):
            return not WHOLE.search(text)
        return not (b"  " in b or b"\n " in b)

    def _encoded(self, text: str) -> np.ndarray:
        if not self._fits(text):
            return self._plain(text)
        first, *pieces = text.split(" ")
        return np.frombuffer(self.first[first] + b"".join(map(self.known.__getitem__, pieces)), self.kind)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. What is new in them is kept as far as there is room, or else until all are done."""
        out = list(map(self._encoded, texts))
        for known, most in ((self.known, CACHED), (self.units, CACHED // 4), (self.first, CACHED // 8)):
            known.cut(most)
        return out


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE - 1, each at least 1."""
    room = (1 << SCALE) - 1 - len(counts)
    out = 1 + (counts.astype(np.float64) * (room / counts.sum())).astype(np.int64)
    out[np.argmax(counts)] += (1 << SCALE) - 1 - out.sum()
    return out.astype(np.uint64)


def encode_block(places: np.ndarray, freq: np.ndarray) -> dict:
    """places: the symbols as indices into freq. Token i belongs to lane i modulo the number of lanes."""
    n = len(places)
    lanes, low = min(LANES, n), np.uint64(32)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    f, c, x = freq[places], start[places], np.full(lanes, 1 << 32, np.uint64)
    steps = -(-n // lanes)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    states = []
    for t in reversed(range(steps)):
        fs, xs = f[t * lanes : t * lanes + lanes], x[: min(lanes, n - t * lanes)]
        over = xs >= fs << np.uint64(64 - SCALE)
        words[t] = xs[over].astype(np.uint32)
        xs = np.where(over, xs >> low, xs)
        q = xs // fs
        x[: len(fs)] = (q << np.uint64(SCALE)) + (xs - q * fs) + c[t * lanes : t * lanes + lanes]
        if t % EVERY == 0:
            states.append(x.astype("<u8").tobytes())
    at = np.cumsum([0, *map(len, words)])
    return {"words": np.concatenate(words).astype("<u4").tobytes(), "places": [int(at[t]) for t in range(0, steps, EVERY)], "states": states[::-1]}


def decode_block(block: dict, freq: np.ndarray, lookup: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Indices into freq, from checkpoint `first` up to checkpoint `last` (the end)."""
    n, x = block["n_tokens"], np.frombuffer(block["states"][first], "<u8").astype(np.uint64)
    lanes, words, pos = len(x), np.frombuffer(block["words"], "<u4").astype(np.uint64), block["places"][first]
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    steps = -(-n // lanes)
    begin, end = first * EVERY, steps if last is None else min(steps, last * EVERY)
    out = np.empty(min(n, end * lanes) - begin * lanes, lookup.dtype)
    for t in range(begin, end):
        m = min(lanes, n - t * lanes)
        xs = x[:m]
        slot = xs & np.uint64((1 << SCALE) - 1)
        s = lookup[slot]
        xs = freq[s] * (xs >> np.uint64(SCALE)) + slot - start[s]
        need = np.flatnonzero(xs < np.uint64(1 << 32))
        xs[need] = (xs[need] << np.uint64(32)) | words[pos : pos + len(need)]
        pos += len(need)
        x[:m] = xs
        out[(t - begin) * lanes : (t - begin) * lanes + m] = s
    return out


def lookup_table(freq: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << SCALE, np.int32)
    table[: int(freq.sum())] = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
    return table


def encode_frame(ids: np.ndarray) -> dict:
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    places = np.cumsum(counts > 0, dtype=np.int32)[ids] - 1
    freq = frequencies(counts[symbols])
    blocks = []
    for at in range(0, len(ids), BLOCK):
        own = ids[at : at + BLOCK]
        blocks.append({"n_tokens": len(own), "crc": zlib.crc32(own.astype("<u4").tobytes())} | encode_block(places[at : at + BLOCK], freq))
    return {"symbols": zlib.compress(np.diff(symbols.astype("<u4"), prepend=0).astype("<u4").tobytes()), "frequencies": zlib.compress(freq.astype("<u4").tobytes()), "blocks": blocks, "n_tokens": len(ids)}


def decode_frame(frame: dict) -> np.ndarray:
    """A frame's ids as 32-bit integers; a block whose CRC differs raises ValueError."""
    symbols = np.cumsum(np.frombuffer(zlib.decompress(frame["symbols"]), "<u4"), dtype=np.uint32)
    freq = np.frombuffer(zlib.decompress(frame["frequencies"]), "<u4").astype(np.uint64)
    lookup, out = lookup_table(freq), []
    for k, block in enumerate(frame["blocks"]):
        ids = symbols[decode_block(block, freq, lookup)].astype("<u4")
        if zlib.crc32(ids.tobytes()) != block["crc"]:
            raise ValueError(f"part {frame['part']}, frame {frame['frame']}, block {k}: its checksum differs")
        out.append(ids)
    return np.concatenate(out)


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by end_id, in ascending doc_id order.

    A null text is empty (end_id alone); null doc_ids come first; rows that share a doc_id (ties) are kept, ordered among
    themselves by their texts' hashes; a very long text makes a frame of its own, cut into blocks; other columns, however
    named, are not read; an empty table makes a file without frames.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        coder, part, number = Pieces.of(tokenizer), TaskContext.get().partitionId(), 0
        names: list = []
        ids: list[np.ndarray] = []

        def frame() -> pd.DataFrame:
            nonlocal number, names, ids
            made = encode_frame(np.concatenate(ids)) | {"part": part, "frame": number, "doc_ids": names, "lengths": [len(i) for i in ids]}
            number, names, ids = number + 1, [], []
            return pd.DataFrame({k: [made[k]] for k in ("part", "frame", "n_tokens", "doc_ids", "lengths", "symbols", "frequencies", "blocks")})

        total = 0
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            keys = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for span in portions(map(len, texts), CHUNK):
                for key, coded in zip(keys[span], coder.encode(texts[span]), strict=True):
                    names.append(key)
                    ids.append(np.append(coded, coder.kind.type(end_id)))
                    total += len(ids[-1])
                    if total >= FRAME:
                        yield frame()
                        total = 0
        if ids:
            yield frame()

    # the hash spreads rows without an id, or with one that very many share, over tasks
    n, order = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["doc_id", "hash"]
    placed = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed.select("doc_id", "text").mapInPandas(run, FRAME_SCHEMA).write.parquet(path)


def read_token_file(spark: SparkSession, path: str, only_crc: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a file: ids as little-endian 32-bit integers, start the ids of all before it.

    With only_crc, ids_crc32 stands for ids, so that the ids themselves don't leave the task that decodes them.
    """
    name, kind, reduce = ("ids_crc32", "long", zlib.crc32) if only_crc else ("ids", "binary", bytes)
    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame in batch.to_dict("records"):
                ids, lengths = decode_frame(frame), np.array(frame["lengths"], np.int64)
                ends = np.cumsum(lengths)
                for at in range(0, len(ends), 2000):
                    own = slice(at, at + 2000)
                    yield pd.DataFrame(
                        {
                            "part": frame["part"],
                            "frame": frame["frame"],
                            "doc_id": pd.array(list(frame["doc_ids"][own]), dtype="Int64"),
                            "inside": (ends - lengths)[own],
                            "n_tokens": lengths[own],
                            name: [reduce(ids[b - m : b].tobytes()) for b, m in zip(ends[own], lengths[own], strict=True)],
                        }
                    )

    docs = frames.mapInPandas(run, f"part int, frame int, doc_id long, inside long, n_tokens long, {name} {kind}")
    sizes = frames.select("part", "frame", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inner = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(parts, F.col("part") == F.col("p")).select("p", F.col("frame").alias("f"), (F.col("own") + F.col("first")).alias("base"))
    placed = docs.join(bases, (F.col("part") == F.col("p")) & (F.col("frame") == F.col("f")))
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", name)


def token_table(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs as a token file, read it back: (doc_id, start, n_tokens, ids_crc32). Without a path, the file goes then."""
    import public_tokenizers

    spark = docs.sparkSession
    place = path or shared_path(spark, "tokens")
    write_token_file(docs, place, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    out = staged(read_token_file(spark, place, only_crc=True), "token-table")
    if not path:
        remove(spark, place)
    return out


def op10_rans_token_files(spark, sf_dir):
    from .common import table

    return token_table(table(spark, sf_dir, "documents"))
