import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeflow.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n", "a \nb", "x\n\ny", " lead", "tail ", "tail\n", "x\n foo", "é ü\tq", "a<|endoftext|>b", "a  b c", "日本 語 x", "don't  do 's", "﻿x y", "a\r\nb c", "\x1cx y", "a\u0085 b", "  x y", "n m o"]


def test_pieces(plain):
    coder = tf.Pieces(PATH)
    for _ in range(2):  # new, then known
        assert [ids.tolist() for ids in coder.encode(ODD)] == [plain(t) for t in ODD]


def test_an_added_token_in_a_text_has_its_own_id(plain):
    assert plain("a<|endoftext|>b") == [64, 50256, 65] == tf.Pieces(PATH).encode(["a<|endoftext|>b"])[0].tolist()


def test_another_splitting_rule_is_left_to_the_library():
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder = tf.Pieces(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["The quick  brown Fox", "don't stop", "Über 12345"]
    assert not coder.cuts and [i.tolist() for i in coder.encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab '.,\n\t\r é  日1")), max_size=25), min_size=1, max_size=4))
def test_pieces_of_any_text(texts):
    coder = tf.Pieces.of(PATH)
    assert [i.tolist() for i in coder.encode(texts)] == [coder._plain(t).tolist() for t in texts]


@pytest.mark.parametrize("n", [1, 2, 511, 4097, 700_000])
@pytest.mark.parametrize("kinds", [1, 2, 3000])
def test_frames_round_trip(n, kinds, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK", 300_000)
    ids = (np.random.default_rng(n + kinds).zipf(1.3, n) % kinds).astype(np.uint16)
    frame = tf.encode_frame(ids) | {"part": 0, "frame": 0}
    assert (tf.decode_frame(frame) == ids).all()


def test_decoding_from_a_checkpoint(monkeypatch):
    monkeypatch.setattr(tf, "LANES", 16)
    monkeypatch.setattr(tf, "EVERY", 10)
    places = np.random.default_rng(1).integers(0, 40, 5000)
    freq = tf.frequencies(np.bincount(places))
    block = tf.encode_block(places, freq) | {"n_tokens": len(places)}
    lookup = tf.lookup_table(freq)
    parts = [tf.decode_block(block, freq, lookup, k, k + 1) for k in range(len(block["places"]))]
    assert len(parts) > 20 and (np.concatenate(parts) == places).all()


def test_damage_is_noticed():
    frame = tf.encode_frame(np.tile(np.arange(500, dtype=np.uint16), 100)) | {"part": 0, "frame": 0}
    words = bytearray(frame["blocks"][0]["words"])
    words[100] ^= 1
    frame["blocks"][0]["words"] = bytes(words)
    with pytest.raises(ValueError):
        tf.decode_frame(frame)


def expected(rows, plain):
    out, start = [], 0
    for i, t in rows:
        ids = [*plain(t or ""), 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, data, plain):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = tf.op10_rans_token_files(spark, data).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows, plain)


def test_edges(spark, edge, empty, tmp_path):
    path = f"file://{tmp_path}/t"
    tf.write_token_file(edge, path, PATH)
    got = tf.read_token_file(spark, path).orderBy("start").collect()
    assert len(got) == 11 and [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 8, 9, 10]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got) and [r["n_tokens"] for r in got if r["doc_id"] in (3, 4)] == [1, 1]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert tf.token_table(empty).count() == 0


def test_what_is_kept_is_bounded(plain, monkeypatch):
    """Pieces over the bound are forgotten after each call, and have the same ids when they come again."""
    monkeypatch.setattr(tf, "CACHED", 16)
    coder = tf.Pieces(PATH)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}{end}" for i in range(k, k + 40)) for k, end in enumerate(["", ",", "?!", "'s", "x1", "\n"])]
    for _ in range(2):
        assert [i.tolist() for i in coder.encode(texts)] == [plain(t) for t in texts]
        assert len(coder.known) == 16 and len(coder.units) <= 4 and len(coder.first) <= 2
