"""Byte-level BPE by corpus-level merge replay: all words of a block of documents are merged together, merge by merge in rank order.

A block (``BLOCK_CHARS`` characters of whole texts; a longer text is a block alone) is cut into words by the vocabulary's pattern, and its different words that the
worker hasn't replayed yet lie in one line of symbols, each linked with its neighbours in the word. An inverted index leads from what a pair of
neighbours makes (its rank) to the places where such pairs stand. The replay takes the ranks in order, each with all its places at once: it joins the pairs
that still stand there and looks only at the two pairs that a new symbol makes with its neighbours, which enter the index under their
own ranks. Where such a rank doesn't lie above the one at hand, only the leftmost place of each word is joined before it is looked for again, so that words come
out as if each had been merged by itself, lowest rank and leftmost first, whatever the vocabulary. A word of any length costs in proportion to its
bytes and merges.

Merging never crosses words, so a block of documents is a corpus of its own: nothing is shuffled, a lost executor repeats blocks, and what a worker
holds is a block, an index of a part of its new words, and a store of words with their ids, emptied above ``STORE_BYTES``. A word that is a token of
the vocabulary is that token, as the tiktoken library has it.

Ids are kept as little-endian unsigned 32-bit integers in a binary column. Decoding joins the bytes of each id.

Defined results: null text is empty and has no ids, null ids are no ids; an id that the vocabulary lacks raises; special tokens written in a text are
ordinary text; repeated rows repeat; an empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, with_field

#: Characters of texts whose words are replayed together.
BLOCK_CHARS = 4_000_000
#: Characters of different words, new to the worker, that lie in one index; a longer word lies in it alone.
REPLAY_CHARS = 4_000_000
#: Bytes of words and ids above which a worker empties its store before the next block; words longer than ``KEPT_WORD`` characters aren't kept.
STORE_BYTES, KEPT_WORD = 64_000_000, 200


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """What each pair of neighbours makes, by ids: any two tokens whose bytes, joined, are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.of: dict[int, int] = {}  # left << 32 | right -> rank
        for token, made in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.of[left << 32 | right] = made
        self.keys = np.array(sorted(self.of) or [-1], np.int64)
        self.made = np.array([self.of.get(k, -1) for k in self.keys.tolist()], np.int64)

    def __call__(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The rank that each pair makes, or -1."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], -1)


class Index:
    """Inverted index: the rank that a pair makes -> the places of left symbols where such pairs stood when they entered; ranks come out in order."""

    def __init__(self):
        self.blocks: dict[int, list[np.ndarray]] = {}
        self.places: dict[int, list[int]] = {}
        self.order: list[int] = []

    def _open(self, rank: int) -> None:
        if rank not in self.places and rank not in self.blocks:
            heapq.heappush(self.order, rank)

    def enter(self, places: np.ndarray, ranks: np.ndarray) -> None:
        """Those of rank -1 make nothing and are left out."""
        by = np.argsort(ranks, kind="stable")[np.count_nonzero(ranks < 0) :]
        places, ranks = places[by], ranks[by]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)] if len(ranks) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            rank = int(ranks[a])
            self._open(rank)
            if b - a > FEW:
                self.blocks.setdefault(rank, []).append(places[a:b])
            else:
                self.places.setdefault(rank, []).extend(places[a:b].tolist())

    def enter_one(self, place: int, rank: int) -> None:
        self._open(rank)
        self.places.setdefault(rank, []).append(place)

    def least(self) -> tuple[int, list[int], list[np.ndarray]] | None:
        """The least rank with its places."""
        if not self.order:
            return None
        rank = heapq.heappop(self.order)
        return rank, self.places.pop(rank, []), self.blocks.pop(rank, [])


#: Places that are cheaper to visit one by one than all at once.
FEW = 24


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each word, as bytes."""
    line = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, len(line)
    symbols = merges.single[line]  # -1 where a symbol was joined to the one before it
    if n and symbols.min() < 0:
        raise KeyError("the vocabulary lacks a byte")
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # places of both neighbours; -1 at the ends of a word
    after[ends[sizes > 0] - 1] = before[starts[sizes > 0]] = -1

    index = Index()
    places = np.flatnonzero(after >= 0)
    index.enter(places, merges(symbols[places], symbols[places + 1]))
    own, nexts, lasts, made_of = memoryview(symbols), memoryview(after), memoryview(before), merges.of.get

    def one_by_one(rank: int, places: list[int]) -> None:
        for k, i in enumerate(places):
            j = nexts[i]
            if j < 0 or own[i] < 0 or made_of(own[i] << 32 | own[j]) != rank:
                continue  # the pair that stood here has gone
            right, left, lower = nexts[j], lasts[i], False
            own[i], own[j], nexts[i] = rank, -1, right
            if right >= 0:
                lasts[right] = i
                if (made := made_of(rank << 32 | own[right])) is not None:
                    index.enter_one(i, made)
                    lower = made <= rank
            if left >= 0 and (made := made_of(own[left] << 32 | rank)) is not None:
                index.enter_one(left, made)
                lower |= made <= rank
            if lower:  # comes before the rest
                for later in places[k + 1 :]:
                    index.enter_one(later, rank)
                return

    def all_at_once(rank: int, places: np.ndarray) -> None:
        second = after[places]
        stands = (second >= 0) & (symbols[places] >= 0)
        places, second = places[stands], second[stands]
        stands = merges(symbols[places], symbols[second]) == rank
        places, second = places[stands], second[stands]
        if not len(places):
            return
        standing, overlap = places, second[:-1] == places[1:]
        if overlap.any():  # of pairs that overlap in a run every other one is joined, from the left
            k = np.arange(len(places))
            kept = (k - np.maximum.accumulate(np.where(np.r_[True, ~overlap], k, 0))) % 2 == 0
            places, second = places[kept], second[kept]
        right, left = after[second], before[places]
        ahead, behind = right >= 0, left >= 0
        following = merges(rank, symbols[right[ahead]])
        preceding = merges(symbols[left[behind]], rank)
        twice = made_of(rank << 32 | rank, -1)
        if any(((r >= 0) & (r <= rank)).any() for r in (following, preceding, np.array([twice]))):  # may come before the rest of a word
            _, leftmost = np.unique(np.searchsorted(ends, places, side="right"), return_index=True)
            index.enter(standing, np.full(len(standing), rank))
            places, second, right, left = places[leftmost], second[leftmost], right[leftmost], left[leftmost]
            ahead, behind = right >= 0, left >= 0
            following, preceding = merges(rank, symbols[right[ahead]]), merges(symbols[left[behind]], rank)
        symbols[places], symbols[second], after[places] = rank, -1, right
        before[right[ahead]] = places[ahead]
        if (right[:-1] == places[1:]).any():  # neighbours were joined as well
            following = merges(rank, symbols[right[ahead]])
            left = before[places]
            behind = left >= 0
            preceding = merges(symbols[left[behind]], rank)
        index.enter(np.concatenate([places[ahead], left[behind]]), np.concatenate([following, preceding]))

    while (found := index.least()) is not None:
        rank, few, blocks = found
        if blocks or len(few) > FEW:
            all_at_once(rank, np.unique(np.concatenate([np.array(few, np.int64), *blocks])))
        else:
            one_by_one(rank, sorted(few))
    alive = symbols >= 0
    ids = symbols[alive].astype("<u4").tobytes()
    bounds = (4 * np.r_[0, np.cumsum(alive)][np.r_[0, ends]]).tolist() if words else []
    return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _groups(words: Iterable[str]) -> Iterator[list[str]]:
    """Words that are replayed together."""
    group, held = [], 0
    for w in words:
        if held > REPLAY_CHARS:
            yield group
            group, held = [], 0
        group.append(w)
        held += len(w)
    if group:
        yield group


class Machine:
    """A vocabulary with the words that a worker has replayed."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of(path)
        self.merges = Merges(self.ranks)
        self.words = regex.compile(pattern)
        self.names = {rank: token for token, rank in self.ranks.items()}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text of a block, as bytes."""
        if self.held > STORE_BYTES:
            self.known, self.held = {}, 0
        parts = [self.words.findall(t) for t in texts]
        new = {w for p in parts for w in p} - self.known.keys()
        for group in _groups(new):
            data = [w.encode("utf-8") for w in group]
            for w, raw, ids in zip(group, data, replay(data, self.merges), strict=True):
                if len(ids) > 4 and raw in self.ranks:  # a word that is a token is that token, also where its merges end elsewhere
                    ids = self.ranks[raw].to_bytes(4, "little")
                self.known[w] = ids
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > KEPT_WORD:
                del self.known[w]
            else:
                self.held += 200 + 8 * len(w)
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.names.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@lru_cache(maxsize=2)
def machine(path: str, pattern: str) -> Machine:
    """One for each Python worker and vocabulary."""
    return Machine(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` (binary)."""
    text, out = free_name(docs, "bytebpe_text"), free_name(docs, out)
    names = [*docs.columns, out]
    kept = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path, pattern)
        for batch in slices(batches, text, BLOCK_CHARS):
            at = batch.schema.get_field_index(text)
            ids = pa.array(own.encode(batch.column(at).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), ids], names)

    return kept.mapInArrow(run, with_field(docs.schema, out, "binary"))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes (binary) of ``ids_col``."""
    out = free_name(df, out)
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path, pattern)
        for batch in batches:
            found = [own.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names)

    return df.mapInArrow(run, with_field(df.schema, out, "binary"))


def round_trips(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text encoded and decoded."""
    ids = encode(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, pattern).select("id", "ids")
    both = decode(ids, path, pattern)
    return both.select(
        F.col("id").alias(id_col), F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
