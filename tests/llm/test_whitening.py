"""Whitening against an eigendecomposition of the exact covariance, and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamworks.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, whitened int, deviation int"


def reference(vectors: np.ndarray, k: int = 4):
    """(distinct rows, mean, eigenvalues, eigenvectors as columns) of integer vectors."""
    u = np.unique(vectors, axis=0)
    c = u - u.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / len(u))
    return u, u.mean(axis=0), e[::-1][:k], q[:, ::-1][:, :k]


def test_query_equals_eigendecomposition(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().set_index("vec_id")
    x = np.floor(256 * np.stack(df.embedding).astype(float))
    u, mean, e, q = reference(x)
    got = queries.op11_whitening(spark, sf).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 4 * len(df) and set(got.n) == {len(u)} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[df.index].to_numpy()
    want = (x - mean) @ q / np.sqrt(e)
    assert np.abs(z * np.sign((z * want).sum(axis=0)) - want).max() < 1e-9
    trace = ((u - mean) ** 2).sum() / len(u)
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), e / trace, rtol=1e-10)
    exact = ((len(u) * x.astype(np.int64) - u.sum(axis=0).astype(np.int64)) ** 2).sum(axis=1)
    assert (got[got.component == 2].set_index("vec_id").deviation.loc[df.index].to_numpy() == exact).all()


@pytest.mark.parametrize("values", [[9, 9, 9, 9, 9, 2], [7, 7, 3, 3, 3, 3], [5, 4, 1, 0, 0, 0], [4, 0, 0, 0, 0, 0]])
def test_repeated_and_missing_singular_values(values):
    """Repeated singular values are all found, and a matrix of low rank ends early."""
    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.normal(size=(40, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = a @ np.diag(values) @ b

    def product(w):
        left = x @ w
        return np.concatenate([left.T @ left[:, -1], x.T @ left[:, -1]])

    s, v, _ = whitening.bidiagonalize(product, 6, float((x**2).sum()), 4)
    assert np.allclose(s, np.sort(values)[::-1][:4], atol=1e-7)
    own = s > 1e-6
    assert np.allclose(np.linalg.norm(x @ v[own].T, axis=0), s[own]) and np.allclose(v @ v.T, np.eye(4), atol=1e-12)


def test_few_steps_suffice_where_few_directions_matter(spark):
    """A steep spectrum converges long before the dimension."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 40)) * (0.35 ** np.arange(40)) * 100
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    *_, e, _ = reference(np.floor(256 * x))
    assert model.steps < 25 and np.allclose(model.eigenvalues, e, rtol=1e-10)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, -2.0]), (2, [0.25, 0.0, 1.0]), (2, [0.25, 0.0, 1.0]), (3, [0.25, 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (5, [0.1, -0.0, 3.0]),
        (6, None), (7, []), (8, [1.0, None, 0.0]), (9, [nan, 0.0, 0.0]), (10, [inf, 0.0, 0.0]), (11, [1.0, 2.0]),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    model = whitening.fit(df)
    assert model.n == 4 and len(model.components) == 3
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "embedding", "x", "whitened", "deviation", "_whitened", "_deviation"]
    kept = got.collect()
    assert sorted(r.vec_id or 0 for r in kept) == [0, 1, 2, 2, 3, 5]
    x = np.floor(256 * np.array([r.embedding for r in kept], float))
    u, mean, e, q = reference(x, 3)
    want, z = (x - mean) @ q / np.sqrt(e), np.array([r._whitened for r in kept])
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-9
    s = u.sum(axis=0)
    assert [int(r._deviation) for r in kept] == [int(((4 * v - s) ** 2).sum()) for v in x]


def test_one_vector_copies_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.fit(df) is None
        assert whitening.whitened_components(df, None).collect() == []
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 5.0])], schema)
    got = whitening.whitened_components(flat, whitening.fit(flat)).orderBy("vec_id").collect()
    assert [r.component for r in got] == [1, 1] and math.isclose(abs(got[0].whitened), 1.0)


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(v), float(-3 * v)]) for i, v in enumerate([0, 2**44, 2**45, 2**46 + 2**20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, whitening.fit(df)).select("embedding", F.col("deviation").cast("string").alias("d")).collect()
    x = [[int(256 * v) for v in r.embedding] for r in got]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert [int(r.d) for r in got] == [sum((4 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
