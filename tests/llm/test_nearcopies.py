"""Near copies: what is compared in a crowd of pages of one template, and that no near pair is lost there."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamworks.llm import nearcopies
from streamworks.llm.common import cut_and_gather
from streamworks.llm.simhash import components


def words(rng, k):
    return ["".join(rng.choices("abcdefghij", k=7)) for _ in range(k)]


def pages(n, seed=1):
    """Pages that share 120 words of 150: below 0.8 of each other."""
    rng = random.Random(seed)
    shared = words(rng, 120)
    return [" ".join(shared + words(rng, 30)) for _ in range(n)]


def run(spark, texts, monkeypatch):
    """Component of each text, and how many pairs were compared."""
    compared = []

    def cut(df, *more):
        kept = cut_and_gather(df, *more)
        if kept.columns == ["p", "q", "a", "b"]:
            compared.append(kept.count())
        return kept

    monkeypatch.setattr(nearcopies, "cut_and_gather", cut)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.struct("doc_id"))
    found = nearcopies.merged(df, df.select("key", F.col("key").alias("component_id")), "key")
    return {r.key.doc_id: r.component_id.doc_id for r in found.collect()}, sum(compared)


def linked(texts):
    """Components by all pairs."""
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_pages_of_a_template_are_compared_in_proportion(spark, monkeypatch):
    small, of_small = run(spark, pages(100), monkeypatch)
    large, of_large = run(spark, pages(200), monkeypatch)
    assert len(set(small.values())) == 100 and len(set(large.values())) == 200
    assert of_large < 3 * of_small and of_large < 200 * nearcopies.CROWD


def test_no_near_pair_is_lost_in_a_crowd(spark, monkeypatch):
    """Among the pages stand pairs that differ in a few words only."""
    texts, rng = pages(60, 2), random.Random(3)
    for i in range(0, 60, 6):
        own = texts[i].split()
        for _ in range(2):
            own[rng.randrange(120, 150)] = "other"
        texts.append(" ".join(own))
    got, _ = run(spark, texts, monkeypatch)
    assert got == linked(texts) and len(set(got.values())) < len(texts)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_rare_shingles_meet_for_every_near_pair(spark, least):
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 1 << 40, 60)
    sets = [np.unique(rng.choice(pool, rng.integers(5, 40))) for _ in range(40)]
    sets += [np.delete(s, 0) for s in sets[:20]]
    df = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "node long, hashes array<bigint>")
    held: dict = {}
    for r in nearcopies.rare_shingles(df, least).collect():
        held.setdefault(r.node, set()).add(r.h)
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        if len(a & b) >= least * len(a | b):
            assert held.get(i, set()) & held.get(j, set())


def test_rounds_take_few_jobs(spark):
    """The driver holds threads and plans for each job of a minute, so the jobs of all rounds are bounded."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    rng = random.Random(5)
    texts = pages(20, 6)
    texts += [f"{t} {rng.choice('xyz')}" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.struct("doc_id"))
    began = jobs()
    found = nearcopies.merged(df, df.select("key", F.col("key").alias("component_id")), "key").collect()
    took = jobs() - began
    assert {r.key.doc_id: r.component_id.doc_id for r in found} == linked(texts)
    assert took < 120


@pytest.mark.parametrize("rows", [100_000, 60])
def test_components_of_chains_and_stars(spark, rows):
    """Whether the edges fit one task or go through steps, also where each task's own are contracted first."""
    rng = random.Random(8)
    nodes = [rng.getrandbits(63) - (1 << 62) for _ in range(500)]
    chain, star, ring = nodes[:300], nodes[300:400], nodes[400:]
    edges = [*itertools.pairwise(chain), *((star[0], x) for x in star[1:]), *itertools.pairwise([*ring, ring[0]]), (chain[0], chain[0])]
    rng.shuffle(edges)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    began = jobs()
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4), rows=rows).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, min(part)) for part in (chain, star, ring) for x in part)
    assert rows == 60 or jobs() - began < 8
