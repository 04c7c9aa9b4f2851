"""What reviews found missing."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from streamworks.llm import nearcopies, packing
from streamworks.llm.common import cut_and_gather

from .test_operators import brute_simhash


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b)


def test_near_dedup_reaches_jaccard_of_four_fifths(spark, sf):
    """Texts with a few changed words go; those below 0.8 that SimHash doesn't link stay."""
    rng = random.Random(3)
    rows, base = [], [[f"w{rng.randrange(10_000)}" for _ in range(120)] for _ in range(60)]
    for i, words in enumerate(base):
        rows.append((10 * i, " ".join(words)))
        for j, changes in enumerate(((10, 60), (30, 90), (15, 40, 65, 90))):  # two make 0.84, four 0.70
            rows.append((10 * i + j + 1, " ".join("new" + w if k in changes else w for k, w in enumerate(words))))
    text = dict(rows)
    assert all(jaccard(text[d], text[d + 1]) >= 0.8 and jaccard(text[d], text[d + 2]) >= 0.8 > jaccard(text[d], text[d + 3]) for d in range(0, 600, 10))
    prints = {d: brute_simhash(t) for d, t in rows}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    assert sum(not near(d, d + 1) for d in range(0, 600, 10)) > 30
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    # d + 1 and d + 2 go; d + 3 goes only where SimHash links it to one of the others
    want = {d for d in range(0, 600, 10)} | {d + 3 for d in range(0, 600, 10) if not any(near(d + 3, d + j) for j in range(3))}
    assert len(want) > 110 and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_packing_plans_with_counts():
    """A plan of ranges is best fit, and stays small for any number of bins."""
    rng = random.Random(4)
    for sizes in ([1, 2, 3, 50, 99, 100], range(1, 101), range(51, 90)):
        counts = {s: rng.randint(1, 40) for s in sizes}
        rows, fills = sorted(packing.plan(counts, 100)), {}
        for k, (size, item, first, each, offset) in enumerate(rows):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == size else counts[size]
            for i in range(item, end):
                fills.setdefault(first + (i - item) // each, []).append((offset + (i - item) % each * size, size))
        for places in fills.values():
            assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1].tolist()] and sum(n for _, n in places) <= 100
        _, _, want = packing.best_fit(np.array([s for s, n in counts.items() for _ in range(n)]), 100)
        assert sorted(sum(n for _, n in p) for p in fills.values()) == sorted(want.tolist())
    assert len(packing.plan({s: 10**7 + s for s in range(1, 2049)}, 2048)) < 20_000


def test_packing_of_bins_that_do_not_merge(spark):
    """Pieces over half of the capacity, which can't merge, and short ones that fill their gaps."""
    pieces = spark.range(0, 6000, 1, 6).select(
        F.col("id").alias("row"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 6 < 5, 1100 + F.col("id") % 800).otherwise(100 + F.col("id") % 50).alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
    )
    bins = {}
    for r in packing.best_fit_packing(pieces, fan_in=2).collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, bins.values())) == 6000 and len(bins) == 5000
    for places in bins.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048


def test_a_large_group_of_near_copies_costs_few_comparisons(spark, monkeypatch):
    """A group in which every text is like about half of the others, beside unlike ones."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join("x" + w if k in set(rng.sample(range(60), 1)) else w for k, w in enumerate(base)) + f" end{i % 7}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.struct("doc_id"))
    seen = []
    monkeypatch.setattr(nearcopies, "cut_and_gather", lambda df: (seen.append(df.count()) if set(df.columns) == {"p", "q", "a", "b"} else None, nearcopies.__dict__["_cut"](df))[1])
    monkeypatch.setattr(nearcopies, "_cut", cut_and_gather, raising=False)
    got = {r.key.doc_id: r.component_id.doc_id for r in nearcopies.merged(docs, docs.select("key", F.col("key").alias("component_id")), "key").collect()}
    texts = dict(rows)
    want = brute_classes(texts)
    assert got == want and sum(seen) < 12 * len(rows)


def brute_classes(texts):
    sets, root = {i: five_words(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_packing_tree_of_pieces_above_half(spark):
    """20,000 pieces that can't merge pass all levels in windows; the root holds counts only, and totals don't get worse."""
    pieces = spark.range(0, 20_000, 1, 70).select(
        F.col("id").alias("row"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (1100 + F.col("id") % 800).alias("length"), F.lit(0).cast("long").alias("ids_crc32")
    )
    got = packing.best_fit_packing(pieces, fan_in=4, window=500)
    assert got.count() == 20_000 == got.select("sequence_id").distinct().count()
    mixed = pieces.withColumn("length", F.when(F.col("row") % 3 == 0, 2048 - F.lit(1100) - F.col("row") % 800).otherwise(F.col("length")))
    bins = mixed.drop("x")
    found = packing.best_fit_packing(bins, fan_in=4, window=500).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("k"), F.count_distinct("offset").alias("o"))
    assert found.filter("n != end OR n > 2048 OR k != o").count() == 0
    whole = packing.best_fit(np.array([r.length for r in mixed.select("length").collect()]), 2048)[2]
    assert found.count() <= 1.02 * len(whole)
