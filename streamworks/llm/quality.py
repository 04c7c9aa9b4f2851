"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Features are statistics of the whole text (``FEATURES``): lengths, shares of kinds of characters, repetition of words
and lines, compressibility. After standardization random Fourier features sqrt(2/D) cos(W x + b) approximate a
Gaussian kernel of width ``sigma``; ridge regression on them needs only the sums Z'Z and Z'y, which each partition adds up
in one D x D matrix and Spark sums in a tree. Sums are kept for two halves of the training rows, so that each half can
be scored by the fit on the other; isotonic regression (pool adjacent violators, on counts in 1/4096 steps of the score) maps these scores
to probabilities. Only sums and counts of fixed size reach the driver, however many rows are labelled.

Defined results: null text is empty and is scored like any other; labels that are null or neither 0 nor 1 don't
count; a document labelled several times counts once for each label; without any label every score is 0.5;
repeated rows repeat; an empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, free_name, slices, tree_sum, with_field

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "exclamation", "symbol", "bar", "punctuation", "space", "newline",
    "non_ascii", "distinct_words", "distinct_lines", "compressed", "log_line_length", "marked_words", "upper_words", "long_words", "bracket",
)


def _byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


_CLASSES = np.stack(
    [
        _byte_class(bytes(range(65, 91))), _byte_class(b"0123456789"), _byte_class(b"!"), _byte_class(b"#$%&*@^~\\_=<>"), _byte_class(b"|"),
        _byte_class(b".,;:?'\"-"), _byte_class(b" \t"), _byte_class(b"\n\r"), _byte_class(bytes(range(128, 256))), _byte_class(b"()[]{}"),
    ],
    axis=1,
)


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    upper, digit, bang, symbol, bar, punct, space, line, wide, bracket = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    words, lines = text.split(), text.split("\n")
    w = len(words) or 1
    kinds = set(words)
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), min(len(text) / w, 50), upper, digit, bang, symbol, bar, punct, space, line, wide,
        len(kinds) / w, len(set(lines)) / len(lines), min(len(zlib.compress(raw, 1)) / n, 1.5), np.log1p(len(text) / len(lines)),
        sum(not x[-1].isalnum() for x in kinds) / (len(kinds) or 1), sum(map(str.isupper, kinds)) / (len(kinds) or 1),
        sum(len(x) > 14 for x in kinds) / (len(kinds) or 1), bracket,
    ])


def with_features(docs: DataFrame, text_col: str = "text", out: str = "features") -> DataFrame:
    text, out = free_name(docs, "quality_text"), free_name(docs, out)
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            found = [features(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(found, pa.list_(pa.float64()))], names)

    return docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, with_field(docs.schema, out, "array<double>"))


@dataclass(frozen=True)
class Fourier:
    """z(x) of standardized features: D cosines and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        std = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phase)) * np.cos(std @ self.weights + self.phase)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


@dataclass(frozen=True)
class Model:
    """``coef`` None: nothing was learnt, every score is 0.5."""

    fourier: Fourier | None
    coef: np.ndarray | None
    steps: np.ndarray  # isotonic regression: scores, and the probability at each
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.coef is None:
            return np.full(len(x), 0.5)
        raw = self.fourier(x) @ self.coef
        # the last word goes to the raw score, so that calibrated ties keep its order; it moves a score by 1e-6 at most
        return np.clip(np.interp(raw, self.steps, self.values) + 1e-6 * (np.tanh(raw - 0.5)), 0, 1)


def _sums(width: int, expand):
    """One row for each partition: fold -> Z'Z, Z'y, as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((2, width, width)), np.zeros((2, width))
        for batch in batches:
            x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(FEATURES)))
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            z = expand(x)
            for f in (0, 1):
                part = z[fold == f]
                gram[f] += part.T @ part
                moment[f] += part.T @ y[fold == f]
        flat = np.concatenate([gram.ravel(), moment.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["sums"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on points in order of x: the middle of each pool and its mean."""
    pools: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    flat = np.array(pools)
    return flat[:, 0] / flat[:, 2], flat[:, 1] / flat[:, 2]


BINS = 4096


def fit(
    rows: DataFrame, features_col: str = "features", label_col: str = "label", dims: int = 384, sigma: float = 5.0, ridge: float = 1e-3, seed: int = 7
) -> Model:
    """Learns from all rows that have a label of 0 or 1."""
    kept = rows.filter(F.col(label_col).isin(0, 1)).select(F.col(features_col).alias("x"), F.col(label_col).cast("double").alias("y"))
    kept = cut_lineage(kept.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(2)).cast("int")))
    k = len(FEATURES)

    moments = tree_sum(kept.mapInArrow(_sums(2 * k + 1, lambda x: np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)), "sums binary"))
    if moments is None:
        return Model(None, None, np.zeros(1), np.full(1, 0.5))
    gram = moments[: 2 * (2 * k + 1) ** 2].reshape(2, 2 * k + 1, 2 * k + 1).sum(axis=0)
    n = gram[-1, -1]
    if not n:
        return Model(None, None, np.zeros(1), np.full(1, 0.5))
    mean = gram[-1, :k] / n
    scale = np.sqrt(np.maximum(gram[-1, k : 2 * k] / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    rng = np.random.Generator(np.random.PCG64(seed))
    fourier = Fourier(mean, scale, rng.normal(0, 1 / sigma, (k, dims)), rng.uniform(0, 2 * np.pi, dims))

    flat = tree_sum(kept.mapInArrow(_sums(dims + 1, fourier), "sums binary"))
    d = dims + 1
    grams, moment = flat[: 2 * d * d].reshape(2, d, d), flat[2 * d * d :].reshape(2, d)

    def solve(g: np.ndarray, m: np.ndarray) -> np.ndarray:
        penalty = ridge * max(g[-1, -1], 1) * np.eye(d)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(g + penalty, m)

    coef = solve(grams.sum(axis=0), moment.sum(axis=0))
    crossed = np.stack([solve(grams[1 - f], moment[1 - f]) for f in (0, 1)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BINS, 2))
        for batch in batches:
            if batch.num_rows:
                z = fourier(np.stack(batch.column("x").to_numpy(zero_copy_only=False)))
                own = crossed[batch.column("fold").to_numpy()]
                at = np.clip(((z * own).sum(axis=1) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
                np.add.at(counts, (at, batch.column("y").to_numpy().astype(int)), 1)
        used = np.flatnonzero(counts.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used, 0]), pa.array(counts[used, 1])], ["bin", "bad", "good"])

    rows_ = kept.mapInArrow(binned, "bin long, bad double, good double").groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = np.array(sorted(tuple(r) for r in rows_.collect()))  # BINS rows at most
    weight = counts[:, 1] + counts[:, 2]
    steps, values = isotonic((counts[:, 0] + 0.5) * 2 / BINS - 0.5, counts[:, 2] / weight, weight)
    return Model(fourier, coef, steps, values)


def with_score(rows: DataFrame, model: Model, features_col: str = "features", out: str = "score") -> DataFrame:
    """``rows`` with the calibrated score of its features."""
    out = free_name(rows, out)
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(features_col)).to_numpy(zero_copy_only=False)
            scores = model.score(np.stack(x)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names)

    return rows.mapInArrow(run, with_field(rows.schema, out, "double"))


def with_text_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of its texts, in one pass."""
    text, out = free_name(docs, "quality_text"), free_name(docs, out)
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            x = [features(t) for t in batch.column(at).to_pylist()]
            scores = model.score(np.stack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(scores)], names)

    return docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, with_field(docs.schema, out, "double"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1. A null id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of each document, written once: whatever follows reads numbers and no texts."""
    return cut_lineage(with_features(docs.select(id_col, text_col), text_col).select(id_col, "features"))


def fit_on_labels(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **options) -> Model:
    """Fits on the labelled rows of ``measured`` that aren't held out."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1))
    train = found.filter(~held_out(id_col)).join(known, F.col(id_col) == F.col("label_id")).select("features", "label")
    return fit(train, "features", "label", **options)
