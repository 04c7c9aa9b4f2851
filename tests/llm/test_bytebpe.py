"""Merge replay against the tiktoken library, its order on hostile vocabularies, and awkward rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from streamworks.llm import bytebpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bytebpe.ranks_of(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bytebpe.machine(PATH, PATTERN).encode(texts)]


def test_query_equals_the_library(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = LIBRARY.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85 　'stvelmdaé1٣汉🙂́<|>"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_any_text(texts):
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("unit", ["a", "ab", " ", "\n", "aaab", "é", "!?", "12", "🙂", "the"])
def test_long_runs(unit):
    text = unit * 30_000
    assert ids([text, "x" + text]) == [LIBRARY.encode_ordinary(text), LIBRARY.encode_ordinary("x" + text)]


def plain(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word by itself: the lowest rank, leftmost first."""
    s = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[x] for x in s]
        _, i = min(found)
        s[i : i + 2] = [s[i] + s[i + 1]]


@pytest.mark.parametrize("few", [0, 2, 24])
def test_ranks_in_any_order(monkeypatch, few):
    """Vocabularies whose merges make pairs of lower rank, or of the rank at hand, come out word by word the same, one by one and all at once."""
    monkeypatch.setattr(bytebpe, "FEW", few)
    rng = random.Random(4)
    for _ in range(300):
        tokens = {bytes([c]) for c in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(rng.randint(3, 30))}
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        words = [bytes(rng.choices(b"abc", k=rng.randint(0, 14))) for _ in range(20)]
        got = bytebpe.replay(words, bytebpe.Merges(ranks))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(w, ranks) for w in words]


def test_other_vocabularies(tmp_path):
    """A word that is a token is that token even where merges don't lead to it, as in the library."""
    tokens = [bytes([i]) for i in range(256)] + [b"bc", b"abc", b"abcd", b"xyzw"]
    ranks = {t: i for i, t in enumerate(tokens)}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
    library = tiktoken.Encoding("o", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["abcd xyzw abcxyzw", "xyzw", ""]
    own = bytebpe.machine(str(path), PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(x).decode() for x in own.encode(texts)] == texts


def test_store_is_emptied_and_long_words_are_not_kept(monkeypatch):
    monkeypatch.setattr(bytebpe, "STORE_BYTES", 5000)
    monkeypatch.setattr(bytebpe, "REPLAY_CHARS", 50)
    own = bytebpe.Machine(PATH, PATTERN)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdefg", k=rng.choice((3, 9, 400)))) for _ in range(10)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
        assert max(map(len, own.known), default=0) <= bytebpe.KEPT_WORD and len(own.known) < 80


def test_awkward_rows(spark):
    rows = [(1, "a b", "x", 3), (1, "a b", "x", 3), (None, None, "x", 3), (2, "", None, 3), (3, " " * 200_000, "x", 3), (4, "<|endoftext|>", "x", 3), (5, "z" * 300_000, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = bytebpe.decode(bytebpe.encode(df, PATH, PATTERN), PATH, PATTERN, ids_col="_ids")
    assert got.columns == ["doc_id", "text", "ids", "decoded", "_ids", "_decoded"]
    found = got.collect()
    assert sorted((r.doc_id or 0, r.text) for r in found if r.text is not None) == sorted((r[0], r[1]) for r in rows if r[1] is not None)
    for r in found:
        assert bytes(r._decoded).decode() == (r.text or "")
        assert np.frombuffer(bytes(r._ids), "<u4").tolist() == LIBRARY.encode_ordinary(r.text or "")
    assert bytebpe.round_trips(df.limit(0), PATH, PATTERN).collect() == []
    clash = bytebpe.round_trips(df.withColumnRenamed("doc_id", "ids_"), PATH, PATTERN, id_col="ids").collect()
    assert len(clash) == len(rows)
