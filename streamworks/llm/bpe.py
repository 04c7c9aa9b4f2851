"""Byte-pair encoding and decoding as a streaming transducer with bounded lookahead.

Every text goes through a ``Transducer``, a block of ``BLOCK`` characters at a time, and its tokens come out as soon as they are stable; what is held is a
block and an unfinished word. White space ends a word, so what stands before the last white space of a block is stable. In a run without white space longer than
a block, words are cut by the vocabulary's pattern; all but the last two of them are stable. And a word longer than ``WINDOW`` bytes goes through
``WordStream``, which merges a window of it and emits the tokens before the last stable boundary.

How far can what follows a token change its right boundary? A merge r = (u, v) that crosses it has a left part u that ends there, so u is the token or ends
it in its tree of merges. r takes place in one continuation and not in another only if an earlier merge r' = (u', v') reaches across v's right end,
so u' is v or ends v, and r' comes earlier in the list. Chains of such merges are finite; ``lookaheads`` adds up the longest |v| + |v'| + ... for each
token by one pass over the list. A boundary with that many symbols after it is stable whatever follows, and what follows a
true boundary is encoded independently of what stands before it.

Decoding is the reverse machine: token ids become bytes, bytes become text by an incremental UTF-8 state
machine that holds at most the three bytes of an unfinished character. A vocabulary file without a decoder spells tokens
out, separated by spaces, as the tokenizers library does.

Defined results: null text is empty and has no tokens; special tokens written in a text become their ids, as the
library does by default; texts of any length need the memory of the text (as Arrow and Python hand it over) and a buffer; repeated rows repeat; an
empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, with_field

OTHER_SPACE = "\x1c\x1d\x1e\x1f"  # str.split() cuts there, \s does not


def byte_chars() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(spare)
            spare += 1
    return [chars[b] for b in range(256)]


class Encoder:
    """A BPE file of the tokenizers library: lower-casing words with an end mark, or any list of merges over bytes."""

    def __init__(self, path: str, most: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.decoder = spec.get("decoder")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        chars = byte_chars()
        self.first = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.ahead_of = self.lookaheads()
        cut = len(self.suffix)
        self.sizes = {i: len(s) - cut if cut and s.endswith(self.suffix) else len(s) for s, i in self.vocab.items()}  # symbols in each token
        self.most = most
        self.known: dict[str, tuple[int, ...]] = {}  # words
        self.chunks: dict[str, bytes] = {}  # what stands between white space
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def lookaheads(self) -> dict[int, int]:
        """For each token the symbols after it that suffice to make its right boundary stable, from the list of merges alone."""
        right: dict[int, int] = {}
        size = {i: 1 for i in {*self.first, *self.last}}
        best: dict[int, int] = {}  # by left part: the longest chain among the merges so far
        for (u, v), (_, new) in self.merges.items():  # in order
            chain, end = 0, v
            while end is not None:
                chain = max(chain, best.get(end, 0))
                end = right.get(end)
            best[u] = max(best.get(u, 0), chain + size.get(v, 1))
            size[new] = size.get(u, 1) + size.get(v, 1)
            right[new] = v
        out: dict[int, int] = {}
        for token in (*size, *self.vocab.values()):  # parts come before what is made of them
            if token not in out:
                out[token] = max(best.get(token, 0), out.get(right.get(token), 0))
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges the earliest-listed, leftmost pair until none is left."""
        merges = self.merges
        if len(symbols) > 48:
            return self._merge_long(symbols)
        ranks = [merges.get(p) for p in zip(symbols, symbols[1:], strict=False)]
        while True:
            at, low = -1, None
            for i, r in enumerate(ranks):
                if r is not None and (low is None or r[0] < low[0]):
                    at, low = i, r
            if low is None:
                return symbols
            symbols[at : at + 2] = [low[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = merges.get((symbols[at - 1], low[1]))
            if at < len(ranks):
                ranks[at] = merges.get((low[1], symbols[at + 1]))

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same by a heap over a linked list."""
        merges, n = self.merges, len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r[0], i, r[1]) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := merges.get(p))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else -1
            if j < 0 or (now := merges.get((symbols[i], symbols[j]))) is None or now[0] != rank:
                continue
            symbols[i], symbols[j], after[i] = new, -1, after[j]
            if (k := after[i]) >= 0:
                before[k] = i
                if r := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (r[0], i, r[1]))
            if (h := before[i]) >= 0 and (r := merges.get((symbols[h], new))):
                heapq.heappush(heap, (r[0], h, r[1]))
        return [x for x in symbols if x >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            data = word.encode("utf-8")
            stream = WordStream(self)
            got = (*stream.feed(data), *stream.finish())
            if len(data) <= 200:  # what is kept stays small
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = got
        return got

    def normal(self, text: str) -> str:
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if self.lower else text  # one letter at a time, so no final sigma

    def chunk(self, chunk: str) -> bytes:
        low = chunk
        if self.lower:
            low = low.replace("Σ", "σ").lower()
        ids = [i for w in self.words.findall(low) for i in self.word(w)]
        data = np.array(ids, "<u4").tobytes()
        if len(chunk) <= 100:
            if len(self.chunks) >= self.most:
                self.chunks.clear()
            self.chunks[chunk] = data
        return data

    def plain(self, text: str) -> bytes:
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        parts = regex.split(r"\s+", text) if any(c in text for c in OTHER_SPACE) else text.split()
        known = self.chunks
        found = list(map(known.get, parts))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = known.get(parts[i]) or self.chunk(parts[i])
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        if self.cut_special is None or not self.cut_special.search(text):
            return np.frombuffer(self.plain(text), "<u4")
        parts = self.cut_special.split(text)
        return np.frombuffer(
            b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts)), "<u4"
        )


#: Bytes of one word that are merged at once at first.
WINDOW = 16


class WordStream:
    """The tokens of one word, emitted as soon as they are stable. It holds a window of the word, or more only where nothing in it is stable."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.held, self.window = encoder, b"", WINDOW

    def feed(self, data: bytes) -> list[int]:
        encoder, out = self.encoder, []
        self.held += data
        while len(self.held) > self.window:
            tokens = encoder.merge([encoder.first[b] for b in self.held[: self.window]])
            done = kept = at = 0
            for i, token in enumerate(tokens):
                at += encoder.sizes[token]
                if self.window - at >= encoder.ahead_of[token]:
                    done, kept = at, i + 1
            if not kept:
                self.window *= 2
                continue
            out += tokens[:kept]
            self.held, self.window = self.held[done:], WINDOW
        return out

    def finish(self) -> list[int]:
        encoder, rest = self.encoder, self.held
        self.held = b""
        return encoder.merge([*(encoder.first[b] for b in rest[:-1]), encoder.last[rest[-1]]]) if rest else []


class Transducer:
    """A text to ids, a block at a time: ids (as little-endian bytes) come out as soon as nothing that follows can change them."""

    KEPT = 32  # characters on both sides that tell whether a run can be cut

    def __init__(self, encoder: Encoder, block: int = 1 << 16):
        self.encoder, self.block, self.pending = encoder, block, ""
        self.running = False  # within a run without white space
        self.seen = 0  # characters of the run that have been searched for it
        self.words = ""  # its end, normalised, not yet cut into words for good
        self.open: tuple[WordStream, regex.Pattern] | None = None  # a word longer than a block, and what continues it

    def feed(self, text: str) -> bytes:
        self.pending += text
        out = b""
        while len(self.pending) > self.block:
            head = self.pending[: self.block]
            if self.running:
                space = SPACE.search(self.pending, self.seen)
                if space:
                    out += self._run(self.pending[: space.start()]) + self._end_run()
                    self.pending = self.pending[space.start() :]
                else:
                    cut = self._safe_cut()
                    if not cut:
                        self.seen = len(self.pending)
                        break  # wait for more
                    out += self._run(self.pending[:cut])
                    self.pending = self.pending[cut:]
                self.seen = 0
                continue
            cut = last_space(head)
            if cut > 0:
                out += self.encoder.encode(head[:cut]).tobytes()
                self.pending = self.pending[cut:]
            else:
                self.running = True
                if cut == 0:
                    self.pending = self.pending[1:]  # white space is no token
        return out

    def finish(self) -> bytes:
        out = b""
        if self.running:
            space = SPACE.search(self.pending)
            at = space.start() if space else len(self.pending)
            out += self._run(self.pending[:at]) + self._end_run()
            self.pending = self.pending[at:]
        out += self.encoder.encode(self.pending).tobytes()
        self.pending = ""
        return out

    def _safe_cut(self) -> int:
        """A place near the end, within the newest block, that no special token and no normalisation reaches across; 0 if there is none."""
        head, k = self.pending, self.KEPT
        for cut in range(len(head) - k, max(k, len(head) - self.block), -1):
            a, b = head[cut - k : cut], head[cut : cut + k]
            if not any(x in a[1 - len(x) :] + b[: len(x) - 1] for x in self.encoder.special):
                if unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b) == unicodedata.normalize("NFC", a + b):
                    return cut
        return 0

    def _run(self, text: str) -> bytes:
        """Part of a run: its words but those that what follows may change."""
        encoder, special = self.encoder, self.encoder.cut_special
        out = b""
        for i, part in enumerate(special.split(text) if special else [text]):
            if i % 2:
                out += self._flush() + np.array([encoder.special[part]], "<u4").tobytes()
                continue
            self.words += encoder.normal(part)
            out += self._words()
        return out

    def _words(self) -> bytes:
        encoder, ids = self.encoder, []
        if self.open:
            stream, more = self.open
            end = more.match(self.words).end()
            if end < len(self.words):
                ids += stream.feed(self.words[:end].encode("utf-8")) + stream.finish()
                self.words, self.open = self.words[end:], None
            else:
                ids += stream.feed(self.words[:-1].encode("utf-8"))
                self.words = self.words[-1:]
                return np.array(ids, "<u4").tobytes()
        found = list(encoder.words.finditer(self.words))
        for m in found[:-2]:
            ids += encoder.word(m[0])
        if len(found) > 2:
            self.words = self.words[found[-2].start() :]
        last = encoder.words.search(self.words) if found else None
        if len(found) >= 2 and (a := list(encoder.words.finditer(self.words))) and len(a[-1][0]) > self.block // 2:
            for m in a[:-1]:  # the word before a long one can't change any more
                ids += encoder.word(m[0])
            self.words, last = self.words[a[-1].start() :], a[-1]
        if last and last.start() == 0 and len(last[0]) == len(self.words) > self.block // 2:
            more = next(c for c in CLASSES if c.match(last[0][1:]))
            if more.fullmatch(last[0][1:]):
                self.open = WordStream(encoder), more
                ids += self.open[0].feed(self.words[:-1].encode("utf-8"))
                self.words = self.words[-1:]
        return np.array(ids, "<u4").tobytes()

    def _flush(self) -> bytes:
        ids = []
        if self.open:
            stream, more = self.open
            end = more.match(self.words).end() if self.words else 0
            ids += stream.feed(self.words[:end].encode("utf-8")) + stream.finish()
            self.words, self.open = self.words[end:], None
        ids += [i for w in self.encoder.words.findall(self.words) for i in self.encoder.word(w)]
        self.words = ""
        return np.array(ids, "<u4").tobytes()

    def _end_run(self) -> bytes:
        self.running = False
        return self._flush()


#: What ends words: the vocabulary's white space, which is less than Python's.
SPACE = regex.compile(r"\s")
#: What a long word of the vocabulary's pattern is made of: letters, or neither letters, digits nor white space (digits are words alone).
CLASSES = (regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+"), regex.compile(r"\p{N}+"))


def last_space(text: str) -> int:
    """The place of the last white space, or -1."""
    for i in range(len(text) - 1, -1, -1):
        if text[i].isspace() and text[i] not in OTHER_SPACE:
            return i
    return -1


class Decoder:
    """Ids to text, a block at a time; between blocks it holds the bytes of one unfinished character at most."""

    def __init__(self, encoder: Encoder):
        self.joined = b"" if encoder.decoder else b" "
        chars = {c: b for b, c in enumerate(byte_chars())}
        special = set(encoder.special.values())
        self.bytes = [b""] * (max(encoder.names) + 1)
        for i, name in encoder.names.items():
            self.bytes[i] = bytes(chars[c] for c in name) if encoder.decoder and i not in special else name.encode("utf-8")
        self.restart()

    def restart(self) -> Decoder:
        self.machine, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False
        return self

    def feed(self, ids: Iterable[int]) -> str:
        data = self.joined.join(map(self.bytes.__getitem__, ids))
        if self.begun and data:
            data = self.joined + data
        self.begun |= bool(data)
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def machines(path: str) -> tuple[Encoder, Decoder]:
    """One pair for each Python worker."""
    encoder = Encoder(path)
    return encoder, Decoder(encoder)


BLOCK = 1 << 16


def blocks_of_ids(encoder: Encoder, text: str) -> Iterator[bytes]:
    machine = Transducer(encoder, BLOCK)
    for i in range(0, len(text), BLOCK):
        yield machine.feed(text[i : i + BLOCK])
    yield machine.finish()


def round_trip(encoder: Encoder, decoder: Decoder, text: str) -> tuple[int, str, str]:
    """Token count and the digests of ids and of the decoded text: ids are hashed and decoded as they come."""
    of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
    decoder.restart()
    for block in blocks_of_ids(encoder, text):
        if block:
            ids = np.frombuffer(block, "<u4").tolist()
            of_ids.update((" " * bool(n) + " ".join(map(str, ids))).encode())
            of_text.update(decoder.feed(ids).encode("utf-8"))
            n += len(ids)
    of_text.update(decoder.finish().encode("utf-8"))
    return n, of_ids.hexdigest(), of_text.hexdigest()


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col``."""
    text, out = free_name(docs, "bpe_text"), free_name(docs, out)
    names = [*docs.columns, out]
    kept = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = machines(path)
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            ids = pa.array([np.frombuffer(b"".join(blocks_of_ids(encoder, t)), "<i4") for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), ids], names)

    return kept.mapInArrow(run, with_field(docs.schema, out, "array<int>"))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``; null ids are no ids."""
    out = free_name(df, out)
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = machines(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [decoder.restart().feed(x or []) + decoder.finish() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return df.mapInArrow(run, with_field(df.schema, out, "string"))


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text encoded and decoded, without moving the ids out of the task."""
    kept = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(path)
        for batch in slices(batches, "text"):
            rows = [round_trip(encoder, decoder, t) for t in batch.column("text").to_pylist()]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
