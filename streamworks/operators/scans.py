"""Scans that depend on all rows before, spread over tasks however many rows one key has.

A serial scan needs the state before each row. Here every range of rows is first summarised as a function of the state before it; the functions of a key's ranges
are composed in order, which gives each range its own start, and then all ranges are scanned at once. What a scan has to bring is a summary that is small and
composes exactly: an affine map for a linear filter, a step function for a highest index.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import cut_lineage
from .windows import KINDS, ordered_scan, runs


class Carried:
    """A scan of one key: its state from row to row, and the summary of rows as a function of the state before them."""

    #: DDL of the columns that it adds.
    added = ""

    def begin(self) -> object:
        """The state before a key's first row."""
        raise NotImplementedError

    def step(self, state: object, part: pa.RecordBatch) -> list:
        """An array for each added column; changes the state."""
        raise NotImplementedError

    def summary(self) -> object:
        """That of no rows."""
        raise NotImplementedError

    def take(self, summary: object, part: pa.RecordBatch) -> None:
        """Adds the next rows to a summary."""
        raise NotImplementedError

    def after(self, state: object, summary: object) -> object:
        """The state after the summarised rows."""
        raise NotImplementedError


def carried_scan(df: DataFrame, keys: list[str], order: str, scan: Carried) -> DataFrame:
    """Adds the columns of ``scan`` (or replaces those of the same name), in order of ``order`` within the keys.

    Rows are dealt by ranges of (keys, order), so a hot key lies in as many tasks as it has ranges, and written once to the shared folder. Only a
    partition's last key can go on in the next one: a partition yields one summary and asks for one start, so that what is composed, in order and by key,
    has two rows for each partition, and the starts are broadcast, one row for each partition at most.
    """
    new = T.StructType.fromDDL(scan.added)
    schema = T.StructType([*[f for f in df.schema if f.name not in new.names], *new])
    kinds = [KINDS[f.dataType.simpleString()] for f in new]
    place = [*keys, order]
    placed = cut_lineage(df.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_at", F.monotonically_increasing_id()))
    ends_schema = T.StructType([*[placed.schema[k] for k in keys], *T.StructType.fromDDL("_at long, _turn long, _rows binary")])
    types, names = [to_arrow_type(f.dataType) for f in ends_schema], ends_schema.names

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, summary = None, None, None
        for batch in batches:
            for key, part in (found := list(runs(batch, keys))):
                if first is None:
                    first = (key, part.column("_at")[0].as_py())
            if found:
                key, part = found[-1]  # a key that ended within the batch isn't the last one
                if summary is None or key != last or len(found) > 1:
                    last, summary = key, scan.summary()
                scan.take(summary, part)
        if first is not None:
            at = first[1]
            rows = [(*first[0], at, 2 * at, None), (*last, at, 2 * at + 1, pickle.dumps(summary))]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    def compose(state: dict, part: pa.RecordBatch) -> list:
        out = []
        for raw in part.column("_rows").to_pylist():
            if raw is None:
                out.append(pickle.dumps(state["now"]) if state["seen"] else None)
            else:
                state |= {"now": scan.after(state["now"], pickle.loads(raw)), "seen": True}
                out.append(None)
        return [out]

    told = ordered_scan(placed.mapInArrow(ends, ends_schema), keys, "_turn", "_start binary", lambda: {"now": scan.begin(), "seen": False}, compose)
    starts = told.filter(F.col("_start").isNotNull()).select("_at", "_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            for key, part in runs(batch, keys):
                if state is None or key != last:
                    start = part.column("_start")[0].as_py() if state is None else None
                    last, state = key, pickle.loads(start) if start else scan.begin()
                found = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(scan.step(state, part), kinds, strict=True)]
                cols = dict(zip(part.schema.names, part.columns, strict=True)) | dict(zip(new.names, found, strict=True))
                yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], schema.names)

    return placed.join(F.broadcast(starts), "_at", "left").mapInArrow(run, schema)


HALF, FULL = 1 << 15, 1 << 16
#: The epoch that a pending count stands for within a summary.
BASE = 4


def next_index(high: int | None, seq: int) -> int:
    """The 48-bit index of a 16-bit number, given the highest index so far."""
    high = high or 0
    if high <= HALF:
        return seq
    epoch, low = high >> 16, high & 0xFFFF
    if low < HALF:
        if seq - low > HALF:
            epoch -= 1
    elif low - HALF > seq:
        epoch += 1
    return ((epoch & 0xFFFFFFFF) << 16) | seq


class Transition:
    """What packets make of the highest index before them, whatever it was: intervals of it with the value that they end at, or None where it stays.

    Above the first half range the rule looks at the low 16 bits only, so one full range stands for all epochs. A packet can only raise the index
    to its own next value, so intervals merge as packets come; there are never more than a range has numbers. With a rollover count pending, the
    rule looks at the distance to that count's epoch, for which ``BASE`` stands; beyond the ends of the interval the first packet decides, or nothing changes.
    Indexes stay below 48 bits.
    """

    def __init__(self, free: bool = True, held: bool = False):
        low = BASE * FULL - HALF - 1
        self.free = [(0, HALF, None, False), (HALF + 1, HALF + FULL, None, False)] if free else []
        self.held = [(low, BASE * FULL + FULL + HALF, None, True)] if held else []
        self.any = False

    def packet(self, seq: int) -> None:
        self.any = True
        self.free = _merged([x for p in self.free for x in _moved(p, seq)])
        self.held = _merged([x for p in self.held for x in _moved(p, seq)])

    def __call__(self, high: int, pending: int = 0) -> tuple[int, int]:
        if not self.any:
            return high, pending
        if pending:
            shift = (pending - BASE) * FULL
            at = max(high - shift, self.held[0][0])
            if at > self.held[-1][1]:
                return high, pending
        else:
            shift = max(0, (high - HALF - 1) // FULL) * FULL
            at = high - shift
        for low, top, value, waits in self.held if pending else self.free:
            if low <= at <= top:
                return (high if value is None else value + shift), pending if waits else 0
        raise AssertionError("intervals cover all values")


def _moved(piece: tuple, seq: int) -> list[tuple]:
    low, high, value, pending = piece
    if pending:
        i = BASE * FULL | seq
        if value is not None:
            if i - value > HALF:
                return [(low, high, i, False)]
            return [(low, high, value if value - i > HALF else max(value, i), True)]
        cuts = [(low, i - HALF - 1, i, False), (i - HALF, i, i, True), (i + 1, high, None, True)]
    elif value is not None:
        return [(low, high, max(value, next_index(value, seq)), False)]
    elif high <= HALF:
        cuts = [(low, seq - 1, seq, False), (seq, high, None, False)]
    else:
        cuts, at = [], low
        for k in range(3):
            top = seq + FULL * k
            reach = top - HALF + (seq < HALF)  # from here on the packet lies ahead
            cuts += [(at, reach - 1, None, False), (max(at, reach), top, top, False)]
            at = max(at, top + 1)
    return [(max(a, low), min(b, high), v, w) for a, b, v, w in cuts if max(a, low) <= min(b, high)]


def _merged(pieces: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for p in pieces:
        if out and out[-1][2:] == p[2:] and p[0] != HALF + 1:  # where another rule begins
            out[-1] = (out[-1][0], p[1], *p[2:])
        else:
            out.append(p)
    return out


class SequenceScan(Carried):
    """The index of each packet, by the highest one before it."""

    added = "index long"

    def begin(self) -> dict:
        return {"high": 0}

    def step(self, state: dict, part: pa.RecordBatch) -> list:
        out, high = [], state["high"]
        for seq in part.column("seq").to_pylist():
            i = next_index(high, seq)
            out.append(i)
            high = max(high, i)
        state["high"] = high
        return [out]

    def summary(self) -> Transition:
        return Transition()

    def take(self, summary: Transition, part: pa.RecordBatch) -> None:
        for seq in part.column("seq").to_pylist():
            summary.packet(seq)

    def after(self, state: dict, summary: Transition) -> dict:
        return {"high": summary(state["high"])[0]}


class EpochScan(Carried):
    """Index and status of each packet where rollover counts may be signalled. A summary has a transition for each signal."""

    added = "index long, epoch_status string"

    def begin(self) -> dict:
        return {"high": 0, "pending": 0}

    def step(self, state: dict, part: pa.RecordBatch) -> list:
        out, said = [], []
        for seq, roc in zip(part.column("seq").to_pylist(), part.column("roc").to_pylist(), strict=True):
            if roc is not None:
                state["pending"] = int(roc)
            high, kind = state["high"], "ok"
            if state["pending"]:
                i = state["pending"] << 16 | seq
                if i - high > HALF:
                    kind, state["pending"] = "pkt_idx_adv", 0
                elif high - i > HALF:
                    kind = "pkt_idx_old"
            else:
                i = next_index(high, seq)
            out.append(i)
            said.append(kind)
            if kind != "pkt_idx_old":
                state["high"] = max(high, i)
        return [out, said]

    def summary(self) -> list:
        return [(None, Transition(held=True))]

    def take(self, summary: list, part: pa.RecordBatch) -> None:
        for seq, roc in zip(part.column("seq").to_pylist(), part.column("roc").to_pylist(), strict=True):
            if roc is not None:
                summary.append((int(roc), Transition(free=not roc, held=bool(roc))))
            summary[-1][1].packet(seq)

    def after(self, state: dict, summary: list) -> dict:
        high, pending = state["high"], state["pending"]
        for roc, move in summary:
            high, pending = move(high, pending if roc is None else roc)
        return {"high": high, "pending": pending}


class FilterScan(Carried):
    """Q13: a cascade of second-order sections, a block of samples at a time: one matrix product with the block, one with the state before it.

    A summary is the number of samples and the state that they leave behind from rest; the state before them comes through by a power of the cascade's own matrix.
    """

    added = "x double"

    def __init__(self, sections: list[np.ndarray], block: int):
        self.block = block
        self.sections = [blocked(s, block) for s in sections]
        self.move = np.zeros((2 * len(sections),) * 2)  # of all sections, by a sample of silence
        for j in range(2 * len(sections)):
            state = np.zeros(2 * len(sections))
            state[j], y = 1.0, 0.0
            for i, (b0, b1, b2, a1, a2) in enumerate(sections):
                own = state[2 * i : 2 * i + 2]
                self.move[2 * i : 2 * i + 2, j] = -a1 * own[0] + own[1] + (b1 - a1 * b0) * y, -a2 * own[0] + (b2 - a2 * b0) * y
                y = b0 * y + own[0]

    def begin(self) -> list[np.ndarray]:
        return [np.zeros(2) for _ in self.sections]

    def step(self, state: list[np.ndarray], part: pa.RecordBatch) -> list:
        y, block = part.column("x").to_numpy(zero_copy_only=False).astype(float), self.block
        for s, (a, c, carry, drive) in enumerate(self.sections):
            out, now = np.empty(len(y)), state[s]
            for i in range(0, len(y), block):
                x = y[i : i + block]
                n = len(x)
                out[i : i + n] = a[:n, :n] @ x + c[:n] @ now
                now = carry[n] @ now + drive[:, block - n :] @ x
            state[s], y = now, out
        return [y]

    def summary(self) -> dict:
        return {"n": 0, "state": self.begin()}

    def take(self, summary: dict, part: pa.RecordBatch) -> None:
        self.step(summary["state"], part)
        summary["n"] += part.num_rows

    def after(self, state: list[np.ndarray], summary: dict) -> list[np.ndarray]:
        if not state:
            return state
        flat = np.linalg.matrix_power(self.move, summary["n"]) @ np.concatenate(state) + np.concatenate(summary["state"])
        return list(flat.reshape(-1, 2))


def blocked(section: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The matrices of a block: output from input and from state, the state's own powers, and the state from input (of the last samples)."""
    b0, b1, b2, a1, a2 = section
    move, into = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(move @ powers[-1])
    impulse = np.array([b0, *((powers[k] @ into)[0] for k in range(block - 1))])
    a = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
    drive = np.stack([powers[block - 1 - j] @ into for j in range(block)], axis=1)
    return a, np.stack([p[0] for p in powers[:block]]), powers, drive
