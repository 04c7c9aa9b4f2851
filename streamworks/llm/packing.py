"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Tokens: ids of a byte-level BPE file as the tokenizers library gives them, then ``end_id``. A document longer
than the capacity is cut into pieces of exactly ``capacity`` tokens, counted from its end, so that only its first
piece may be shorter.

Packing is a tree. Each partition packs its pieces best-fit, longest first, in windows, and emits its nearly full bins
(``slack`` or fewer tokens free, or fewer than the shortest item has) for good. The underfull bins of ``fan_in`` partitions are the items of the next level, as long as
their fill: one task packs them best-fit again, in windows, emits what is nearly full by then and hands the rest up, until one group is left. The root
packs what reaches it best-fit once more, but as counts: there are fewer fills than ``capacity``, so it plans with the number of bins
of each fill, and a plan's row places a numbered range of them. Tasks then number the bins of each fill and look their places up, row by row.
So no task holds more than a window of items, whatever their lengths (bins above half of the capacity may all reach the root), and the plan's size
doesn't depend on the table's.

Defined results: null text is empty (one piece with ``end_id`` alone); repeated rows are packed as separate documents;
equal lengths go by document and piece; an empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_chars
from .common import cut_lineage, slices

PIECES = "row long, piece int, start long, length long, ids_crc32 long"


#: Fixed value: how byte-level pre-tokenizers of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """The ids that the tokenizers library gives for a byte-level file, by tiktoken's merges over the same vocabulary.

    Both merge the earliest-listed pair first. tiktoken looks a merge up by the bytes it makes; that is the same merge, because a
    token's bytes, once cut off from their neighbours, can only have been merged as in the list. It needs ids in the order of the list.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        made = [vocab[m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["model"].get("end_of_word_suffix") or spec.get("normalizer"):
            raise ValueError("not a byte-level vocabulary in the order of its merges")
        value = {c: b for b, c in enumerate(byte_chars())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(value[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def of(self, text: str) -> bytes:
        """Little-endian 32-bit ids; special tokens written in the text become their ids, as the library does by default."""
        parts = self.cut_special.split(text) if self.cut_special and "<|" in text else [text]
        return b"".join(np.array([self.special[p]] if i % 2 else self.encoding.encode_ordinary(p), "<u4").tobytes() for i, p in enumerate(parts))


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One for each Python worker."""
    return TextIds(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but, at most, the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, text_col: str, row: Column, path: str, end_id: int, capacity: int) -> DataFrame:
    """(row, piece, start, length, ids_crc32): a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = text_ids(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for row_id, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = store.of(text) + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((row_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["row", "piece", "start", "length", "ids_crc32"])

    return docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, and the bins' fills."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces: list[int] = []  # the distinct free spaces, in order
    fills: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(spaces, size)
        if at == len(spaces):
            b = len(fills)
            fills.append(0)
        else:
            b = open_bins[spaces[at]].pop()
            if not open_bins[spaces[at]]:
                spaces.pop(at)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if free := capacity - fills[b]:
            if not open_bins[free]:
                insort(spaces, free)
            open_bins[free].append(b)
    return bins, offsets, np.array(fills, np.int64)


#: Sequence ids of the root begin here, above those of the levels below.
PLANNED = 1 << 62


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, of ``counts`` items of each size: rows (size, item, bin, each, offset).

    A row places the items of a size from number ``item`` on up to the next row's: ``each`` of them in a bin, one after the other from ``offset``, and on
    with the next bin. Bins with equal contents are one range, so the rows grow with the number of sizes only.
    """
    rows, bins = [], 0
    ranges: dict[int, list[tuple[int, int]]] = {}  # by free space: (first bin, number of bins)
    spaces: list[int] = []

    def add(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in ranges:
                insort(spaces, free)
            ranges.setdefault(free, []).append((first, n))

    for size in sorted(counts, reverse=True):
        item, left = 0, counts[size]
        while left:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                free = spaces[at]
                first, n = ranges[free].pop()
                if not ranges[free]:
                    del ranges[free]
                    spaces.pop(at)
            else:
                free, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            # the bin with the least space that fits stays it until the size fits no more
            each = free // size
            full = min(n, left // each)
            over = min(left - full * each, each) if full < n else 0
            rows.append((size, item, first, each, capacity - free))
            add(free - each * size, first, full)
            if over:
                add(free - over * size, first + full, 1)
            add(free, first + full + bool(over), n - full - bool(over))
            item += full * each + over
            left -= full * each + over
    return rows


def _pack(capacity: int, window: int, size: str, names: tuple[str, str, str], level: int):
    """Packs rows by their ``size`` in windows of so many; adds the bin, the offset in it and the bin's fill under ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, used = (level << 56) + (TaskContext.get().partitionId() << 36), 0

        def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal used
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets, fills = best_fit(t.column(size).to_numpy(), capacity)
            out = pa.RecordBatch.from_arrays([*t.columns, pa.array(bins + base + used), pa.array(offsets), pa.array(fills[bins])], [*t.schema.names, *names])
            used += len(fills)
            return out

        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= window:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, fill) with the task and the row's number among those of its fill in the task."""
    from pyspark import TaskContext

    task, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        fills = b.column("fill").to_numpy()
        no = np.zeros(len(fills), np.int64)
        order = np.argsort(fills, kind="stable")
        kinds, starts, sizes = np.unique(fills[order], return_index=True, return_counts=True)
        for fill, start, n in zip(kinds.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            no[order[start : start + n]] = seen.get(fill, 0) + np.arange(n)
            seen[fill] = seen.get(fill, 0) + n
        yield pa.RecordBatch.from_arrays([b.column("leaf"), b.column("fill"), pa.array(np.full(len(fills), task, np.int32)), pa.array(no)], ["leaf", "fill", "task", "no"])


def _place(rows: list[tuple[int, int, int, int, int]]):
    """(leaf, fill, item) to (leaf, sequence_id, shift), by the plan."""
    size, item, first, each, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    # each size has its row of item 0; numbers of items are below 2^48
    keys = (size << 48) + item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fill, no = b.column("fill").to_numpy().astype(np.int64), b.column("item").to_numpy()
            at = np.searchsorted(keys, (fill << 48) + no, side="right") - 1
            nth = no - item[at]
            yield pa.RecordBatch.from_arrays(
                [b.column("leaf"), pa.array(PLANNED + first[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * fill)], ["leaf", "sequence_id", "shift"]
            )

    return run


def best_fit_packing(pieces: DataFrame, capacity: int = 2048, slack: int = 16, fan_in: int = 8, window: int = 200_000) -> DataFrame:
    """``pieces`` (row, piece, length and more) with sequence_id and offset. The bins of ``fan_in`` partitions meet in one task of the next level."""
    local = cut_lineage(pieces.mapInArrow(_pack(capacity, window, "length", ("leaf", "at", "fill"), 0), f"{_ddl(pieces)}, leaf long, at long, fill long"))
    under = local.filter(F.col("fill") < capacity - slack).select("leaf", "fill")
    shortest = local.agg(F.min("fill")).first()[0] or 0
    groups, level, moved = -(-local.rdd.getNumPartitions() // fan_in), 0, None
    while groups > 1:
        level += 1
        items = under.repartition(groups, "leaf").distinct()
        packed = cut_lineage(items.mapInArrow(_pack(capacity, window, "fill", ("node", "shift", "total"), level), "leaf long, fill long, node long, shift long, total long"))
        moved = _onward(moved, packed.select("leaf", F.col("node").alias("sequence_id"), "shift"))
        under = packed.filter((F.col("total") < capacity - slack) & (F.col("total") <= capacity - shortest)).select(F.col("node").alias("leaf"), F.col("total").alias("fill"))
        groups = 1 if groups <= fan_in else -(-groups // fan_in)
    numbered = cut_lineage(under.repartition(max(1, -(-local.rdd.getNumPartitions() // fan_in)), "leaf").distinct().mapInArrow(_number, "leaf long, fill long, task int, no long"))
    held = numbered.groupBy("fill", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("fill").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("fill", "task", before.alias("before"))
    # at most as many rows as there are fills
    rows = plan({r.fill: r.n for r in held.groupBy("fill").agg(F.sum("n").alias("n")).collect()}, capacity)
    items = numbered.join(starts, ["fill", "task"]).select("leaf", "fill", (F.col("before") + F.col("no")).alias("item"))
    moved = _onward(moved, items.mapInArrow(_place(rows), "leaf long, sequence_id long, shift long"))
    found = local.join(moved, "leaf", "left")
    return found.select(
        *pieces.columns, F.coalesce("sequence_id", "leaf").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset")
    )


def _onward(moved: DataFrame | None, more: DataFrame) -> DataFrame:
    """(leaf, sequence_id, shift) of leaves that moved, with the next level's moves behind them."""
    if moved is None:
        return more
    then = more.select(F.col("leaf").alias("sequence_id"), F.col("sequence_id").alias("to"), F.col("shift").alias("by"))
    return moved.join(then, "sequence_id", "left").select("leaf", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 2048, **packing
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each document."""
    pieces = cut_lineage(tokenized(docs, text_col, F.col(id_col).cast("long"), tokenizer_path, end_id, capacity))
    return best_fit_packing(pieces, capacity, **packing).withColumnRenamed("row", id_col)
