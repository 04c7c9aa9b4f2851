"""Running values carried over buckets against plain windows, and how a hot key spreads."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from streamworks.operators import catalog as C
from streamworks.operators import windows as W

SCHEMA = "k string, c int, n long, tie int, v double, s string"


def rows(seed, hot=0.8, n=600):
    rng = random.Random(seed)
    at = rng.sample(range(-3000, 3000), n)
    return [
        ("hot" if rng.random() < hot else rng.choice(["a", "b", None]), rng.choice([1, None]) if rng.random() < 0.1 else 1, a if rng.random() < 0.97 else None, i,
         None if rng.random() < 0.3 else rng.uniform(-5, 5), rng.choice(["x", "y", None]))
        for i, a in enumerate(at)
    ]


KINDS = {
    "total": ("sum", "v"), "place": ("count", "v"), "top": ("max_before", "v"), "now": ("last", "s"), "was": ("last_before", "s"), "head": ("first", "s"), "low": ("min", "v"),
}


@pytest.mark.parametrize("bucket", [7, 500, 1 << 16])
def test_carry_equals_plain_windows(spark, bucket):
    df = spark.createDataFrame(rows(bucket), SCHEMA).repartition(4)
    own = Window.partitionBy("k", "c").orderBy("n", "tie")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumns({
        "total": F.sum("v").over(upto), "place": F.count("*").over(upto), "top": F.max("v").over(before), "now": F.last("s", ignorenulls=True).over(upto),
        "was": F.last("s", ignorenulls=True).over(before), "head": F.first("s").over(upto), "low": F.min("v").over(Window.partitionBy("k", "c")),
    })
    got = W.carry(df, ["k", "c"], ["n", "tie"], {name: (kind, F.col(c)) for name, (kind, c) in KINDS.items()}, bucket)
    assert got.columns == plain.columns
    key = lambda r: r.tie
    for a, b in zip(sorted(got.collect(), key=key), sorted(plain.collect(), key=key), strict=True):
        assert a[:6] == b[:6] and a[7:] == b[7:]
        assert (a.total is None) == (b.total is None) and (a.total is None or abs(a.total - b.total) < 1e-9)


def test_as_of_over_buckets(spark):
    rng = random.Random(3)
    left = [(rng.choice(["h", "h", "h", "a", None]), rng.randrange(0, 5000)) for _ in range(500)]
    right = [(rng.choice(["h", "a"]), n, i) for i, n in enumerate(rng.sample(range(5000), 60))]
    got = W.as_of(spark.createDataFrame(left, "k string, n long"), spark.createDataFrame(right, "k string, n long, v int"), ["k"], "n", ["v"], 100)
    want = []
    for k, n in left:
        before = [(m, v) for j, m, v in right if j == k and m <= n]
        want.append((k, n, max(before)[1] if before else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_hot_key_spreads_over_tasks(spark):
    """One key with four fifths of all rows: no task windows more than twice the median of the tasks."""
    df = spark.range(40_000).select(F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = W.carry(df, ["k"], "n", {"place": ("count", F.lit(1))}, 250).withColumn("part", F.spark_partition_id())
        sizes = sorted(r["count"] for r in got.groupBy("part").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2] and sum(sizes) == 40_000
    assert got.filter("k = 'hot'").agg(F.max("place")).first()[0] == 32_000


def test_large_tables_get_more_partitions(spark, monkeypatch):
    """Slices and seeking deal rows by their count: no task gets more than a few times TASK_ROWS, with the same results."""
    frames = spark.range(40_000).selectExpr(
        "concat('f', id % 5000) AS file_id", "id div 5000 AS frame_idx", "id div 5000 * 400 + id % 40 AS pts", "id % 3 = 0 AS key_frame", "id AS pos")
    targets = spark.range(5000).selectExpr("concat('f', id) AS file_id", "id % 3000 AS pts")
    made = lambda: (C.slice_index(frames, 1000, at_key=True), C.seek_as_of(targets, frames))
    usual = [sorted(map(tuple, df.collect()), key=repr) for df in made()]
    monkeypatch.setattr(W, "TASK_ROWS", 1000)
    for df, want in zip(made(), usual, strict=True):
        assert sorted(map(tuple, df.collect()), key=repr) == want
        spread = df.withColumn("part", F.spark_partition_id())
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            sizes = [r["count"] for r in spread.groupBy("part").count().collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert max(sizes) < 3000
