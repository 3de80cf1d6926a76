"""Encoding in blocks: the library's ids, whatever the text, and no work word by word in Python."""

import random
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, bpe_blocks, packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(queries.TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(queries.TOKENIZER)


def encoded(model, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe_blocks.BlockEncoder(model).batch(texts)]


def library(tokenizer, texts):
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def invented(n, seed=0, letters="aeinorst"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(n)]


def test_packing_encodes_new_words_without_a_call_for_each(model, monkeypatch):
    monkeypatch.setattr(packing, "small_batches", lambda *_: None)
    monkeypatch.setattr(packing, "broadcast_model", lambda *_: SimpleNamespace(value=model))
    docs = SimpleNamespace(sparkSession=None, schema=T.StructType([T.StructField("doc_id", T.LongType())]), select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    run, words, calls = packing.pieces_of(docs, queries.TOKENIZER, 4096, 1), invented(20_000, 7), 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    batch = pa.record_batch([pa.array([1]), pa.array([", ".join(words)])], names=["doc_id", "text"])
    bpe.forget_words()
    sys.setprofile(count)
    try:
        out = list(run([batch]))
    finally:
        sys.setprofile(None)
    assert sum(out[0].column("length").to_pylist()) > len(words) and calls < len(words) / 4


def test_every_code_point_in_blocks(model, tokenizer):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    for first in range(0, len(points), 1 << 16):
        texts = [f"a{c}b {c} {c}{c}'s1{c}" for c in points[first : first + (1 << 16)]]
        assert encoded(model, texts) == library(tokenizer, texts)


def test_awkward_texts_in_blocks(model, tokenizer):
    texts = [None, "", " ", "\n", "'s", "''s", "!'s", "it's'll'llx're're've'vex'd'm'tt", "'", "'r", "'l", "1'l", "1's2're3", "x'", "\0", "\0\0", "a\0", "\0a\0\0", "\x1c\x1d", "12345 ６７ ٣٤", "é'é 'ś", "É'S", "İ'S ΑΣ", " x　y\x85z\xa0", "<|endoftext|>", "a<|endoftext|><|startoftext|>'s<|endoftext|>1", "<|ENDOFTEXT|> <|endoftext", "é" * 11, "é" * 12, "x" * 23, "x" * 24, "x" * 23 + "\0", "x" * 24 + " " + "y" * 300, "漢字" * 40, "🙂" * 9, "<|endoftext|>" + "x" * 40]
    assert encoded(model, texts) == library(tokenizer, texts)


def test_random_texts_in_blocks_that_end_anywhere(model, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_blocks, "BLOCK", 40)
    monkeypatch.setattr(bpe_blocks, "SLICE", 50)
    monkeypatch.setattr(bpe_blocks, "KEPT_WORDS", 200)
    rng, parts = random.Random(3), ["'", "'s", "'re", "'l", "l", "The", "é", "ß", "é", "1", "²", "!", "...", " ", "  ", "\n", "　", "<|endoftext|>", "<", "|", "漢", "\0", "thing" * 6, "zq", "Σ", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + [" ".join(invented(500, 5)), None]
    monkeypatch.setattr(bpe_blocks, "remembered", lambda *_: bpe_blocks.KnownWords(200))
    assert encoded(model, texts) == library(tokenizer, texts)


def test_words_that_are_known_forgotten_and_met_again(model, tokenizer):
    known = bpe_blocks.KnownWords(100)
    encoder = bpe_blocks.BlockEncoder(model)
    encoder.known = known
    for seed in (1, 2, 1, 3):
        texts = [" ".join(invented(300, seed)), ", ".join(invented(300, seed + 10)), "x" * 50]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(texts)] == library(tokenizer, texts)
    assert known.n < 1300


def test_another_pattern_of_words_is_an_error(model):
    other = SimpleNamespace(words=r"\S+")
    with pytest.raises(ValueError, match="words are cut by"):
        bpe_blocks.BlockEncoder(other)
