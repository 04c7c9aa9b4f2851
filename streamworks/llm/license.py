"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Words are lower-cased and stripped of marks at their ends. For each template size class (a power of two of words) a text is cut
into windows of twice that many words, one size apart, so that any run as long as the template lies whole in some window.
A window and a template that share at least ``threshold`` of the template's shingles have a known least Jaccard
similarity s; the number b of bands (one row each) is the least with 1 - (1 - s)^b >= ``recall``, so a match is missed with
a probability below 1 - recall for each of the windows that hold it. Equal band values join windows to templates, and the exact containment
of the template's shingles in the window decides.

A cheap exact filter comes first: for each template some of its longest words, which touch more than 1 - threshold of its
shingles; a window without any of them can't match. Documents, then windows, without such a word are left out before any
hashing.

Only DataFrame functions are used. The templates are a parameter; the table of their bands is broadcast if it has at most
``BROADCAST_ROWS`` rows, so the windows and their shingles are not shuffled; a larger one is joined by a shuffle.

A window may hold a template several times: shared shingles that stand once in the template follow its order, so where the order falls or a gap is
longer than the template, another occurrence begins. Each occurrence is measured by itself. Windows overlap and templates resemble each other: an occurrence
goes if a better one of the same text (more of its template's shingles, then the greater containment, the earlier start, end and the later name) shares more than half of the words of the shorter of
the two. So different licences that stand close together all stay.

Defined results: null and empty texts have no matches; texts shorter than a window are one window; a template shorter than a shingle
counts as one shingle; rows that agree in id and text are one document, all others are told apart, also without ids; no templates, no matches; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .license_texts import NOTICES, TEXTS

#: One-line notices, headers and full texts.
TEMPLATES = NOTICES | TEXTS
SHINGLE = 5
#: Rows of templates' bands that are broadcast at most, about 100 bytes each and their shingles.
BROADCAST_ROWS = 50_000
#: Words of a text within which occurrences are compared.
STRETCH = 64
EDGES = r"""^[\"'(\[{<*#!?.,;:$%&|]+|[\"')\]}>*#!?.,;:$%&|]+$"""


def words(text: Column) -> Column:
    """Lower-cased words without the marks at their ends; what is only marks goes."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, EDGES, "")), lambda w: w != "")


def words_of(text: str) -> list[str]:
    """The same of a template, on the driver."""
    return [w for w in (re.sub(EDGES, "", w) for w in text.lower().split()) if w]


def shingles_of(found: list[str], k: int = SHINGLE) -> list[str]:
    return list(dict.fromkeys(" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))))


def anchors(found: list[str], threshold: float, before: set[str] = frozenset(), k: int = SHINGLE) -> set[str]:
    """Words of which a match must hold at least one; those of other templates ``before`` are taken first."""
    own = [set(s.split(" ")) for s in shingles_of(found, k)]
    picked = {w for w in before if any(w in s for s in own)}
    while sum(1 for s in own if s & picked) <= (1 - threshold) * len(own) + 1e-9:
        left = Counter(w for s in own if not s & picked for w in s)
        picked.add(max(left, key=lambda w: (len(w), left[w], w)))  # long words are rare in other texts
    return picked


def bands(size: int, threshold: float, recall: float, k: int = SHINGLE) -> int:
    """How many single-row bands make a match collide with probability ``recall`` in a window of 2 ``size`` words."""
    own = max(1, size // 2 + 1 - k + 1)  # a template of this class has at least so many shingles
    window = max(1, 2 * size - k + 1)
    s = threshold * own / (window + (1 - threshold) * own)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def minhash(hashes: Column, count: int) -> Column:
    """array<struct<band, value>>: for each band the least of the shingles' hashes under that band's permutation."""
    each = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(each, lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))).alias("value")))


def size_class(n: int) -> int:
    return 1 << max(2, math.ceil(math.log2(n)))


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """(id, template, start_word, end_word, containment): a row for each match; words are counted from 0, the end is exclusive."""
    spark = docs.sparkSession
    listed = {name: words_of(t) for name, t in (TEMPLATES if templates is None else templates).items()}
    listed = {name: w for name, w in listed.items() if w}
    if not listed:
        return docs.select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("template", "string"), ("start_word", "int"), ("end_word", "int"), ("containment", "double"))]).limit(0)
    sizes = sorted({size_class(len(w)) for w in listed.values()})
    any_anchor: set[str] = set()
    for w in listed.values():
        any_anchor |= anchors(w, threshold, any_anchor)
    any_anchor = sorted(any_anchor)
    has_anchor = F.lower(F.col("text")).rlike("(?U)" + "|".join(map(re.escape, any_anchor)))
    rows = []
    for name, w in listed.items():
        own = shingles_of(w)
        times = Counter(" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1)))
        rows.append((name, size_class(len(w)), len(w), own, [s if times[s] == 1 else None for s in own]))
    hashed = lambda s: F.transform(s, lambda x: F.xxhash64(x))
    known = spark.createDataFrame(rows, "template string, size int, n_words int, shingles array<string>, ordered array<string>")

    # a row's key: its id (in a struct, so that nulls join) and its text
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.hash(text_col).alias("h"))
    text = docs.select(row.alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & has_anchor)
    cut = text.select("id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    # starts: 0, size, 2 size, ... while a run of that size that starts before the next one isn't whole in this window
    cut = cut.select("id", "w", size).select(
        "id", "w", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1 - F.col("size")), F.col("size"))).alias("start")
    )
    windows = cut.select("id", "size", "start", F.slice("w", F.col("start") + 1, 2 * F.col("size")).alias("w"))
    windows = windows.filter(F.exists("w", lambda x: x.isin(any_anchor)))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - SHINGLE + 1))
    windows = windows.withColumn("shingles", F.transform(at, lambda i: F.array_join(F.slice(F.col("w"), i, SHINGLE), " ")))

    def banded(df: DataFrame) -> DataFrame:
        by_size = F.lit(None).cast("array<struct<band:int,value:bigint>>")
        for s in sizes:
            by_size = F.when(F.col("size") == s, minhash(hashed(F.col("shingles")), bands(s, threshold, recall))).otherwise(by_size)
        return df.withColumn("b", F.explode(by_size)).select("*", F.col("b.band").alias("band"), F.col("b.value").alias("value")).drop("b")

    of_templates = banded(known.withColumnRenamed("shingles", "own").withColumn("shingles", F.col("own"))).select(
        "template", "n_words", "own", "ordered", "size", "band", "value"
    )
    # the templates' rows are counted here, on the driver; beyond the bound they are joined by a shuffle
    if sum(bands(size_class(len(w)), threshold, recall) for w in listed.values()) <= BROADCAST_ROWS:
        of_templates = F.broadcast(of_templates)
    hits = banded(windows).join(of_templates, ["size", "band", "value"])
    # a window and template meet in several bands
    near = F.size(F.array_intersect("own", "shingles")) / F.size("own")
    hits = hits.filter(near >= threshold - 1e-9).select("id", "template", "start", "n_words", "own", "ordered", "shingles")
    # places of shingles that stand once in the template, with their number in it
    places = F.filter(F.transform("shingles", lambda x, i: F.struct(i.alias("i"), F.array_position("ordered", x).alias("t"))), lambda p: p["t"] > 0)
    at = F.col("places")
    fresh = lambda p, j: (j == 0) | (p["t"] <= F.get(at, j - 1)["t"]) | (p["i"] - F.get(at, j - 1)["i"] > F.col("n_words"))
    begins = F.filter(F.transform(at, lambda p, j: F.when(fresh(p, j), j)), lambda j: j.isNotNull())
    one = lambda j, n: F.struct(F.get(at, j)["i"].alias("a"), F.get(at, F.coalesce(F.get(F.col("begins"), n + 1), F.size(at)) - 1)["i"].alias("b"))
    found = hits.withColumn("places", places).withColumn("begins", begins).withColumn("o", F.explode(F.transform("begins", one)))
    within = F.slice("shingles", F.col("o.a") + 1, F.col("o.b") - F.col("o.a") + 1)
    found = found.withColumn("held", F.size(F.array_intersect("own", within))).withColumn("containment", F.col("held") / F.size("own")).filter(F.col("containment") >= threshold - 1e-9)
    placed = found.select(
        "id", "template", "held", "containment", (F.col("start") + F.col("o.a")).alias("start_word"),
        (F.col("start") + F.col("o.b") + F.least(F.lit(SHINGLE), F.col("n_words"))).alias("end_word"),
    ).distinct()
    placed = cut_lineage(placed)
    # occurrences that overlap share a stretch of the text
    cells = F.explode(F.sequence(F.floor(F.col("start_word") / STRETCH), F.floor((F.col("end_word") - 1) / STRETCH))).alias("cell")
    rank = F.struct("held", "containment", (-F.col("start_word")).alias("s"), (-F.col("end_word")).alias("e"), "template")
    names = ["id", "template", "start_word", "end_word"]
    mine = placed.select(*names, rank.alias("rank"), cells)
    other = placed.select("id", F.col("start_word").alias("a"), F.col("end_word").alias("b"), rank.alias("better"), cells)
    shared = F.least("b", "end_word") - F.greatest("a", "start_word")
    shorter = F.least(F.col("b") - F.col("a"), F.col("end_word") - F.col("start_word"))
    lost = mine.join(other, ["id", "cell"]).filter((F.col("better") > F.col("rank")) & (2 * shared > shorter)).select(*names).distinct()
    kept = placed.join(lost, names, "left_anti")
    return kept.select(F.col("id.id").alias(id_col), "template", F.col("start_word").cast("int").alias("start_word"), F.col("end_word").cast("int").alias("end_word"), "containment")
