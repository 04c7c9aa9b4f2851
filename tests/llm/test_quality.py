"""The classifier's fit against one plain numpy fit over the same rows, and what a score may depend on."""

import numpy as np
from pyspark.sql import functions as F

from streamworks.llm import quality


def plain_isotonic(x, y, w):
    """The greatest convex minorant of the weighted sums, by all pairs: the fitted value at i is the least over j >= i of the greatest over k <= i of the mean of k..j."""
    n = len(x)
    mean = [[(y[k : j + 1] * w[k : j + 1]).sum() / w[k : j + 1].sum() if k <= j else 0 for j in range(n)] for k in range(n)]
    return np.array([min(max(mean[k][j] for k in range(i + 1)) for j in range(i, n)) for i in range(n)])


def test_isotonic_equals_min_max():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 25))
        x, y, w = np.sort(rng.normal(size=n)), rng.integers(0, 4, n) / 3, rng.integers(1, 5, n).astype(float)
        steps, values = quality.isotonic(x, y, w)
        want = plain_isotonic(x, y, w)
        assert np.allclose(np.unique(np.round(want, 9)), np.unique(np.round(values, 9)))
        assert np.all(np.diff(values) > -1e-12) and np.all(np.diff(steps) > 0)


def test_fit_equals_plain_numpy(spark):
    """Sums over many partitions solve to what one matrix of all rows does."""
    rng = np.random.default_rng(2)
    k, dims, sigma, ridge, seed = len(quality.FEATURES), 40, 5.0, 1e-3, 7
    x = rng.normal(3, 2, (500, k))
    y = (x[:, 0] + np.sin(x[:, 1]) + rng.normal(0, 0.5, 500) > 3.5).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "features array<double>, label int").repartition(7)
    model = quality.fit(df, dims=dims, sigma=sigma, ridge=ridge, seed=seed)
    fold = {tuple(r.features): r.fold for r in df.select("features", F.pmod(F.xxhash64("features"), F.lit(2)).alias("fold")).collect()}
    fold = np.array([fold[tuple(a)] for a in x.tolist()])

    scale = x.std(axis=0)
    draw = np.random.Generator(np.random.PCG64(seed))
    weights, phase = draw.normal(0, 1 / sigma, (k, dims)), draw.uniform(0, 2 * np.pi, dims)
    std = (x - x.mean(axis=0)) / scale
    z = np.concatenate([np.sqrt(2 / dims) * np.cos(np.clip(std, -1e9, 1e9) @ weights + phase), np.ones((500, 1))], axis=1)
    assert np.allclose(model.fourier(x), z, atol=1e-6)

    def solve(rows):
        penalty = ridge * len(rows) * np.eye(dims + 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ y[rows])

    assert np.allclose(model.coef, solve(np.arange(500)), atol=1e-6)
    crossed = np.stack([solve(np.flatnonzero(fold == 1 - f)) for f in (0, 1)])
    at = np.clip(((z * crossed[fold]).sum(axis=1) + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    used = np.unique(at)
    w = np.array([(at == b).sum() for b in used], float)
    steps, values = quality.isotonic((used + 0.5) * 2 / quality.BINS - 0.5, np.array([y[at == b].mean() for b in used]), w)
    assert np.allclose(model.values, values, atol=0.02) and abs(len(model.values) - len(values)) <= 2
    raw = z @ solve(np.arange(500))
    assert np.mean(np.abs(model.score(x) - np.clip(np.interp(raw, steps, values), 0, 1)) < 1e-3) > 0.95


def test_scores_depend_on_texts_alone(spark, sf):
    """Other languages, sources and ids of unlabelled rows change no score; labels change it through the fit only."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_on_labels(quality.measured(docs), labels)
    scored = lambda df: {r.text: r.p for r in quality.with_text_score(df, model, out="p").select("text", "p").collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.reverse("source")).withColumn("doc_id", -F.col("doc_id")).withColumn("n_chars", F.lit(0))
    assert scored(docs) == scored(other)
    held = quality.held_out()
    swapped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))  # of rows that are held out
    assert np.allclose(quality.fit_on_labels(quality.measured(docs), swapped).coef, model.coef)


def test_sums_keep_the_tasks_of_the_lowest_level(spark):
    """Each task adds one to the sum, so the sum tells how many there were."""
    import pyarrow as pa

    from streamworks.llm.common import tree_sum

    def one(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([np.array([1.0, 2.0]).tobytes()], pa.binary())], ["sums"])

    for n in (1, 3, 70):
        assert tree_sum(spark.range(0, 1000, numPartitions=n).mapInArrow(one, "sums binary"), fan_in=4).tolist() == [n, 2.0 * n]
    assert tree_sum(spark.range(0).mapInArrow(lambda batches: iter(()), "sums binary")) is None
