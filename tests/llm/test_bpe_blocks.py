"""Ends of blocks: separators that Python takes for white space and the vocabulary doesn't, and tokens that come out before their word ends."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from streamworks.llm import bpe, pii

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return lambda text: own.encode(text, add_special_tokens=False).ids


def ids(text):
    return np.frombuffer(b"".join(bpe.blocks_of_ids(bpe.machines(PATH)[0], text)), "<u4").tolist()


PIECES = ["a", "b ", "!!", "\x1c", "\x1d\x1e", "\x1f", " ", "\x85", "é", "é", "<|endoftext|>", "<|start", "The ", "123", "\n", "🙂", "it's", "x" * 30, "Σ", "　", "!" * 40]


@pytest.mark.parametrize("block", [20, 80])
def test_separators_at_the_ends_of_blocks(monkeypatch, library, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(3000):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 60)))
        assert ids(text) == library(text), repr(text)


@pytest.mark.parametrize("mark", ["\x1c", "\x1d", "\x1e", "\x1f", "<|endoftext|>"])
def test_separators_at_the_end_of_a_whole_block(library, mark):
    for shift in range(6):
        text = "a " * (32_766 - shift) + "!!" + mark * 3 + "!! " + "b " * 20
        assert ids(text) == library(text)


def test_run_without_a_place_to_cut(library):
    """Marks that combine leave no place to cut a run; it waits, searches the newest block only, and ends right."""
    text = "x" + "́" * 400 + "y" * 100 + " end"
    machine, out = bpe.Transducer(bpe.machines(PATH)[0], 64), b""
    for i in range(0, len(text), 64):
        out += machine.feed(text[i : i + 64])
    assert np.frombuffer(out + machine.finish(), "<u4").tolist() == library(text)


def test_tokens_come_out_before_the_end_of_their_word(monkeypatch, sf, spark):
    """On the given table some tokens are emitted while their word goes on."""
    early, feed = [], bpe.WordStream.feed
    monkeypatch.setattr(bpe.WordStream, "feed", lambda self, data: early.append(feed(self, data)) or early[-1])
    encoder = bpe.Encoder(PATH)
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        list(bpe.blocks_of_ids(encoder, row.text or ""))
    assert sum(map(len, early)) > 20


def test_many_spans_in_one_text(spark):
    """Time goes with the text's length, however many spans it has."""
    import time

    text = " ".join(f"user{i}@example.com" for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.with_spans(df.limit(0)).collect()
    began = time.time()
    (row,) = pii.span_digests(df).collect()
    assert row.n_email == 60_000 and time.time() - began < 40
