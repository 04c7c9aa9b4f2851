"""The pipeline stage by stage against brute force, and on awkward rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from streamworks.llm import pii, quality

from .test_advice import brute_classes
from .test_operators import DOCS, SCHEMA, brute_components, brute_line_dedup, brute_simhash


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_stages_equal_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = set(docs.columns)
    kept = corpus_pipeline.quality_filter(spark, docs, sf)
    model = quality.fit_on_labels(quality.measured(docs), spark.read.parquet(f"{sf}/labels.parquet"))
    want = [r for r in rows(docs) if model.score(quality.features(r[1])[None])[0] >= 0.5]
    assert rows(kept) == want and set(kept.columns) == columns

    deduped = corpus_pipeline.line_dedup(spark, kept, sf)
    new = brute_line_dedup(want, 3)
    want = [(i, new[i, t]) for i, t in want]
    assert rows(deduped) == want and set(deduped.columns) == columns
    assert deduped.filter(F.length("text") != F.col("n_chars")).count() == 0

    one = corpus_pipeline.near_dedup(spark, deduped, sf)
    names = dict(zip([i for i, _ in want], brute_components([i for i, _ in want], [brute_simhash(t) for _, t in want]), strict=True))
    near = brute_classes(dict(want))
    for _ in range(10):  # both relations together
        low = {}
        for i in names:
            least = min(names[i], names[near[i]])
            for k in (("s", names[i]), ("n", near[i])):
                low[k] = min(low.get(k, least), least)
        names = {i: min(low["s", names[i]], low["n", near[i]]) for i in names}
    want = [r for r in want if r[0] == names[r[0]]]
    assert rows(one) == want and set(one.columns) == columns

    masked = corpus_pipeline.mask_pii(spark, one, sf)
    found = pii.find([t for _, t in want], pii.default_field())
    want = [(i, pii.mask(t, both)) for (i, t), (_, both) in zip(want, found, strict=True)]
    assert rows(masked) == want and set(masked.columns) == columns
    assert not any(pii.base_spans(t) for _, t in want if "@" in t)

    packed = corpus_pipeline.pack(spark, masked, sf)
    assert packed.select("doc_id").distinct().count() == len(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "pii", "best-fit packing"]


def test_near_dedup_without_ids(spark, sf):
    """Rows without ids are told apart by their texts; equal rows are one."""
    words = ["alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black"]
    rows_ = [(None, words[0]), (None, words[1]), (None, words[1]), (3, words[2]), (3, words[2]), (4, words[2].upper()), (5, None), (6, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows_, "doc_id long, text string"), sf)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, words[0]), (None, words[1]), (3, words[2]), (5, None)]))


def test_run_is_registered(spark, sf):
    assert "pipeline" in __spark_entry__.queries()
    got = corpus_pipeline.run(spark, sf)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and got.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_awkward_rows(spark, sf, stage):
    docs = spark.createDataFrame([(*d, 1, "x", 2, "f", "s", "p", 3, "r", 4, "k") for d in DOCS], SCHEMA)
    _, fn = corpus_pipeline.STAGES[stage]
    got = fn(spark, docs, sf)
    if stage < 4:
        assert got.columns == docs.columns
    n = got.count()
    assert n == {0: n, 1: len(DOCS), 2: n, 3: len(DOCS)}.get(stage, n) and n > 0
    assert fn(spark, docs.limit(0), sf).count() == 0
