"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of their centred, distributed rows.

Vectors are integer (``floor(scale * x)``). The fit list X holds each different vector once, written to the shared folder; every product runs over
it where it lies, and what comes back from a step are sums of as many numbers as a vector has dimensions, plus one for each earlier step.

A step takes the next right vector v_j, forms u = X v_j - beta u_(j-1), takes out of it what points along earlier left vectors, and sends it back as
X'u for the next right vector. Both sides are reorthogonalised in full. Left vectors have as many entries as X has rows, so they are never
stored: u_j lies in the span of X's columns and is kept by its coefficients w_j (u_j = X w_j), from which each task rebuilds its part. Inner products of
the new left vector with all earlier ones and X'u come out of the same pass; a second pass follows only where the first took more than half of the vector
away. Right vectors live on the driver, where they are orthogonalised twice.

The singular values of the small bidiagonal matrix, squared and divided by n, are the eigenvalues of the covariance (divisor n), its right singular vectors
give the components. The loop ends where the wanted triplets have converged to ``tolerance`` and the part of X that lies outside the subspace weighs less
than the last wanted triplet, so that no direction is missed, not even a repeated eigenvalue; else it goes on to the full dimension. An
invariant subspace restarts it with a new direction.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; of several dimensions the one with most
different vectors takes part (ties: the greater); rows with null ids or repeated ids stay, repeated vectors count once in the fit; a component without
variance can't be scaled and is left out, so an empty table, a single vector or copies of one give no component. Extra columns stay. Signs are
fixed by each component's largest entry, which is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_and_gather, free_name, tree_sum

TOLERANCE = 1e-14
#: Rows of the fit list that a task has at least, where they are few: each step is a pass, and a pass of many small tasks is mostly waiting.
TASK_ROWS = 4096


@dataclass
class Model:
    """What a fit learns: centre (exact sums and count), components by falling eigenvalue, and figures of the fit."""

    scale: float
    n: int
    sums: list[int]
    components: np.ndarray  # one row each, of unit length
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace

    def matrix(self) -> np.ndarray:
        """Centred rows times this are whitened."""
        return self.components.T / np.sqrt(self.eigenvalues)


def integer_vector(vec: str | Column, scale: float) -> Column:
    """``vec`` in whole steps, or null where it takes no part."""
    x = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(x.isNotNull() & (F.size(x) > 0) & finite, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _blocks(batches: Iterator[pa.RecordBatch], column: str, d: int) -> Iterator[np.ndarray]:
    """The integer vectors of each batch as rows of a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(batch.schema.get_field_index(column)).flatten().to_numpy().reshape(-1, d)


def _totals(rows: DataFrame, d: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Adds up ``of_block`` over the fit list: in each task, then in a tree; the driver gets one row of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, "x", d):
            part = of_block(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["sums"])

    return tree_sum(rows.mapInArrow(run, "sums binary"))


def _exact_sums(rows: DataFrame, d: int) -> list[int]:
    """Sums of each dimension, of any size: high and low halves apart, joined as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for x in _blocks(batches, "x", d):
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (a << 32) + b for t, a, b in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(28, 0)))], ["v"])

    parts = rows.mapInArrow(run, "v array<decimal(28,0)>").select(F.posexplode("v").alias("at", "v"))
    got = dict(parts.groupBy("at").agg(F.sum("v")).collect())
    return [int(got[i]) for i in range(d)]


def _new_direction(v: list[np.ndarray], d: int, rng: np.random.Generator) -> np.ndarray:
    while True:
        x, _ = _orthogonal(rng.normal(size=d), v)
        if (size := np.linalg.norm(x)) > 1e-3:
            return x / size


def _orthogonal(x: np.ndarray, basis: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """``x`` without what points along ``basis``, and its length."""
    if basis:
        m = np.stack(basis)
        for _ in range(2):
            x = x - m.T @ (m @ x)
    return x, float(np.linalg.norm(x))


def bidiagonalize(product: Callable[[np.ndarray], np.ndarray], d: int, mass: float, wanted: int, tolerance: float = TOLERANCE, seed: int = 11):
    """(singular values, right singular vectors as rows, steps) of centred rows X.

    ``product(W)``, for a matrix of columns, gives (X W)'X w followed by X'X w, w being the last of them. ``mass`` is the sum of all squares of X.
    """
    rng = np.random.default_rng(seed)
    v, w, z, alphas, betas = [_new_direction([], d, rng)], [], [], [], []
    size = np.sqrt(mass)
    while True:
        j = len(alphas)
        new = v[j] - (betas[-1] * w[-1] if betas else 0.0)
        for _ in range(3):
            got = product(np.stack([*w, new], axis=1))
            along, square, back = got[:j], got[j], got[j + 1 :]
            left = square - along @ along
            if j:
                new, back = new - np.stack(w, axis=1) @ along, back - np.stack(z, axis=1) @ along
            if left > 0.5 * square or square <= (tolerance * size) ** 2:
                break
        alpha = np.sqrt(max(left, 0.0))
        if alpha <= tolerance * size:  # v_j brings nothing new
            alpha, new, back = 0.0, np.zeros(d), np.zeros(d)
        else:
            new, back = new / alpha, back / alpha
        alphas.append(alpha), w.append(new), z.append(back)
        following, beta = _orthogonal(back - alpha * v[j], v)
        if beta <= tolerance * size:
            beta = 0.0
        p, s, qt = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        k = min(wanted, len(s))
        outside = mass - float(s @ s)
        if len(v) == d or (len(s) >= wanted and np.all(beta * np.abs(p[-1, :k]) <= tolerance * s[0]) and outside < 0.999 * s[k - 1] ** 2):
            return s[:k], qt[:k] @ np.stack(v), len(v)
        betas.append(beta)
        v.append(following / beta if beta else _new_direction(v, d, rng))


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 4, scale: float = 256.0, tolerance: float = TOLERANCE) -> Model | None:
    """Learns from all vectors of ``df``; None where no component has variance."""
    rows = cut_and_gather(df.select(integer_vector(vec_col, scale).alias("x")).filter(F.col("x").isNotNull()).distinct(), TASK_ROWS)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    if not sizes:
        return None
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.filter(F.size("x") == d)
    sums = _exact_sums(rows, d)
    mean = np.array([s / n for s in sums])
    mass = float(_totals(rows, d, lambda x: np.array([((x - mean) ** 2).sum()]))[0])
    if n < 2 or not mass:
        return None

    def product(columns: np.ndarray) -> np.ndarray:
        def of_block(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            left = centred @ columns
            return np.concatenate([left.T @ left[:, -1], centred.T @ left[:, -1]])

        return _totals(rows, d, of_block)

    values, vectors, steps = bidiagonalize(product, d, mass, min(components, d), tolerance)
    kept = values > 1e-10 * values[0]
    values, vectors = values[kept], vectors[kept]
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    model = Model(float(scale), n, sums, vectors, values**2 / n, mass / n, 0.0, steps)
    model.identity_error = _identity_error(rows, d, model)
    return model


def _identity_error(rows: DataFrame, d: int, model: Model) -> float:
    """The largest entry of the whitened rows' covariance (centred first, divisor n) minus the identity."""
    mean, matrix, k = model.mean, model.matrix(), len(model.components)
    middle = _totals(rows, d, lambda x: ((x - mean) @ matrix).sum(axis=0)) / model.n

    def squares(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ matrix - middle
        return (z.T @ z).ravel()

    return float(np.abs(_totals(rows, d, squares).reshape(k, k) / model.n - np.eye(k)).max())


def whiten(df: DataFrame, model: Model | None, vec_col: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows of ``df`` that take part, with their whitened vector (array<double>) and their exact squared deviation.

    The deviation is the sum over dimensions of (n x - S)^2 as decimal(38,0), null where it has more than 38 digits.
    """
    x, out = free_name(df, "integer_vector"), free_name(df, out)
    deviation = free_name(df.withColumn(out, F.lit(0)), deviation)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.DecimalType(38, 0))])
    names = schema.names
    d = len(model.sums) if model else 0
    rows = df.withColumn(x, integer_vector(vec_col, model.scale if model else 1.0)).filter(F.size(x) == d if model else F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, matrix, sums = model.mean, model.matrix(), np.array(model.sums, object)
        most = max(map(abs, model.sums))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(x)
            block = batch.column(at).flatten().to_numpy().reshape(-1, d)
            if d * (model.n * int(np.abs(block).max()) + most) ** 2 < 2**63:
                apart = ((model.n * block - sums.astype(np.int64)) ** 2).sum(axis=1)
                exact = pa.array(apart, pa.int64()).cast(pa.decimal128(38, 0))
            else:
                apart = ((model.n * block.astype(object) - sums) ** 2).sum(axis=1)
                exact = pa.array([Decimal(v) if v < 10**38 else None for v in apart], pa.decimal128(38, 0))
            z = pa.array(((block - mean) @ matrix).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), z, exact], names)

    return rows.mapInArrow(run, schema)


def whitened_components(df: DataFrame, model: Model | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each row of ``df`` that takes part and each component: (id, component, n, deviation, whitened, explained, identity_error)."""
    found = whiten(df.select(id_col, vec_col), model, vec_col).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(e)) for e in model.explained)) if model else F.array(F.lit(0.0))
    return found.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
