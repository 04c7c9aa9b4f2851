"""Line dedup: a suffix array over line ids finds repeated runs of lines; all but their first copies are deleted.

The rule: a line goes if it lies in a run of consecutive lines of one document, of ``min_words`` words or more in all, that also stands, as
a whole, at an earlier place (in order of id, text, line) which it doesn't overlap. Blank lines stay out of it. So the first copy of a run stays
whole, also where a run repeats within a document: twelve lines of two words keep five of them if ``min_words`` is ten.

How it is found:

1. Rank 0 of a position is the place of its line's id among the ids of all lines that occur twice or more. Other lines end every run.
2. Prefix doubling: the rank over 2^(j+1) lines is the place of the pair (rank over 2^j lines here, rank over 2^j lines 2^j further on) among
   all distinct pairs that occur twice or more. Pairs are aggregated, then sorted by range over all tasks; the ordered partitions number the ranks. A
   suffix whose 2^j lines are unique is in its place and drops out. Rounds go on until all suffixes are: log2 of the longest repeated run.
3. Suffixes that share their first e lines are one interval of the suffix array, of longest common prefix e or more; its name is the two ranks over
   2^j <= e lines that cover its e lines from both ends. The intervals just heavy enough (``min_words`` words with their last or first line, but not
   without it) lie in all others that count. The least position of each is the first copy.
4. A later copy and its source share more than that: their longest common prefix comes from the rank levels, longest first (equal ranks over
   2^j lines: 2^j lines further). With pairs left out that go on from the line before, these are the maximal repeated runs.
5. What lies in any of them (up to its own source, if that is in the same document) is deleted.

Every step is an aggregation (combined before its shuffle), a range sort of distinct keys, an equi-join whose skewed side Spark splits, or a window over one
document. Only DataFrame functions are used.

Defined results: null text stays null; null ids come first; rows that agree in id and text are one document and fare alike; an empty
table gives an empty result; blank lines stay; a document whose lines all go keeps its row, with empty text. Extra columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage, free_name

#: From three words on, repeats are copies; lines of one or two words repeat by chance (README has the counts).
MIN_WORDS = 3


def _lines(text: Column) -> Column:
    """array<struct<at, h1, h2, words>> of the lines that aren't blank; 96 bits tell lines apart."""
    found = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    kept = F.filter(found, lambda x: F.trim(x["line"]) != "")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return F.transform(kept, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h1"), F.hash(x["line"]).alias("h2"), (spaces(F.trim(x["line"])) + 1).alias("words")))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, k, q, at, h1, h2, words): each line that isn't blank; d holds the id (a struct, so that null ids join), k tells texts of one id apart."""
    own = docs.filter(F.col(text_col).isNotNull()).select(F.struct(F.col(id_col).alias("id")).alias("d"), F.col(text_col).alias("text"))
    return own.select("d", F.xxhash64("text").alias("k"), F.posexplode(_lines(F.col("text"))).alias("q", "x")).select(
        "d", "k", "q", F.col("x.at").alias("at"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), F.col("x.words").alias("words")
    )


def _ranked(keys: DataFrame, by: list[str], out: str) -> DataFrame:
    """Numbers distinct keys in their order: ranges of keys are in order, and so are the numbers in and over partitions."""
    return cut_lineage(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(out, F.monotonically_increasing_id()))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(d, k, q, at, words, r): positions of lines that occur at least twice, with rank 0."""
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    ranks = _ranked(counts, ["h1", "h2"], "r")
    return lines.join(ranks, ["h1", "h2"]).select("d", "k", "q", "at", "words", "r").repartition("d", "k").dropDuplicates(["d", "k", "q"])


def _own() -> Window:
    return Window.partitionBy("d", "k").orderBy("q")


def suffix_ranks(level: DataFrame) -> list[DataFrame]:
    """(d, k, q, r) for each j: the rank over 2^j lines, of positions whose 2^j lines are repeated."""
    levels = [level.select("d", "k", "q", "r")]
    while True:
        step = 1 << (len(levels) - 1)
        # the row 2^j further on is the line 2^j further on if all between are repeated too; else the pair is unique
        ahead = levels[-1].select("*", F.lead("q", step).over(_own()).alias("q2"), F.lead("r", step).over(_own()).alias("r2"))
        pairs = cut_lineage(ahead.filter(F.col("q2") == F.col("q") + step).drop("q2"))
        again = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r", "r2")
        ranks = _ranked(again, ["r", "r2"], "next")
        if ranks.isEmpty():
            return levels
        levels.append(cut_lineage(pairs.join(ranks, ["r", "r2"]).select("d", "k", "q", F.col("next").alias("r"))))


def least_intervals(at: DataFrame, levels: list[DataFrame], min_words: int) -> DataFrame:
    """(d, k, q, e, a, b): the intervals just heavy enough that each position is in, named by their ranks."""
    used = [j for j in range(len(levels)) if 1 << j <= min_words]
    row = at.withColumnRenamed("r", "r0")
    for j in used[1:]:
        row = row.join(levels[j].withColumnRenamed("r", f"r{j}"), ["d", "k", "q"], "left")
    row = row.withColumn("near", F.collect_list(F.struct("q", "words", *[f"r{j}" for j in used])).over(_own().rowsBetween(0, min_words - 1)))
    # neighbours in the text, not only in the table
    row = row.withColumn("near", F.filter("near", lambda x, i: x["q"] == F.col("q") + i))
    total = lambda n: F.aggregate(F.slice(F.col("near"), 1, n), F.lit(0), lambda a, x: a + x["words"])
    first = F.col("near")[0]["words"]
    fits = lambda e: (total(e) >= min_words) & ((total(e) - first < min_words) | (total(e - 1) < min_words))
    row = row.withColumn("e", F.explode(F.filter(F.sequence(F.lit(1), F.size("near")), fits)))
    a, b = F.lit(None).cast("long"), F.lit(None).cast("long")
    for j in used:
        inside = F.col("e") >= (1 << j)
        a = F.when(inside, F.col("near")[0][f"r{j}"]).otherwise(a)
        b = F.when(inside, F.get("near", F.col("e") - (1 << j))[f"r{j}"]).otherwise(b)
    longest = (1 << (used[-1] + 1)) - 1  # no run beyond is repeated
    return row.filter(F.col("e") <= longest).select("d", "k", "q", "e", a.alias("a"), b.alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def later_copies(intervals: DataFrame) -> DataFrame:
    """(d, k, q, fd, fk, fq): positions of later copies, each with the first copy of its interval."""
    place = F.struct("d", "k", "q")
    firsts = intervals.groupBy("e", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("e", "a", "b", "first")
    firsts = cut_lineage(firsts)  # read anew, the join below is one of two shuffled sides, whose hot keys Spark splits
    apart = (F.col("d") != F.col("first.d")) | (F.col("k") != F.col("first.k")) | (F.col("q") >= F.col("first.q") + F.col("e"))
    later = intervals.join(firsts, ["e", "a", "b"]).filter((place != F.col("first")) & apart)
    return later.select("d", "k", "q", F.col("first.d").alias("fd"), F.col("first.k").alias("fk"), F.col("first.q").alias("fq"))




def maximal_runs(copies: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(d, k, q, n): runs of n lines that are copies of earlier ones, as long as they go on."""
    same = (F.col("d") == F.col("fd")) & (F.col("k") == F.col("fk"))
    by = Window.partitionBy("d", "k", "fd", "fk", "shift").orderBy("q")
    pairs = copies.repartition("d", "k").distinct().withColumn("shift", F.col("q") - F.col("fq"))
    # a pair that goes on from the line before is part of that pair's run (within a document that run may end at its own source)
    starts = pairs.withColumn("before", F.lag("q").over(by)).filter(same | F.col("before").isNull() | (F.col("before") != F.col("q") - 1))
    run = cut_lineage(starts.select("d", "k", "q", "fd", "fk", "fq", F.lit(0).alias("n")))
    for j in reversed(range(len(levels))):
        here = levels[j].select(F.col("d").alias("xd"), F.col("k").alias("xk"), F.col("q").alias("xq"), F.col("r").alias("here"))
        there = here.withColumnsRenamed({"xd": "yd", "xk": "yk", "xq": "yq", "here": "there"})
        own = (F.col("d") == F.col("xd")) & (F.col("k") == F.col("xk")) & (F.col("q") + F.col("n") == F.col("xq"))
        source = (F.col("fd") == F.col("yd")) & (F.col("fk") == F.col("yk")) & (F.col("fq") + F.col("n") == F.col("yq"))
        both = run.join(here, own, "left").join(there, source, "left")
        run = both.select("d", "k", "q", "fd", "fk", "fq", (F.col("n") + F.when(F.col("here") == F.col("there"), 1 << j).otherwise(0)).alias("n"))
    return run.select("d", "k", "q", F.when(same, F.least("n", F.col("q") - F.col("fq"))).otherwise(F.col("n")).alias("n"))


def deleted_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, k, lines): the numbers of the lines that go, for each document (id in d, text hash k) that has any."""
    at = cut_lineage(repeated_lines(cut_lineage(positions(docs, id_col, text_col))))
    levels = suffix_ranks(at)
    copies = later_copies(cut_lineage(least_intervals(at, levels, min_words)))
    ends = maximal_runs(copies, levels).groupBy("d", "k", "q").agg(F.max(F.col("q") + F.col("n")).alias("end"))
    reached = F.max("end").over(_own().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gone = at.select("d", "k", "q", "at").join(ends, ["d", "k", "q"], "left").withColumn("reached", reached).filter(F.col("reached") > F.col("q"))
    return gone.groupBy("d", "k").agg(F.collect_set("at").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, out: str | None = None) -> DataFrame:
    """``docs`` without the lines of later copies; ``out`` names a column for the number of lines that went."""
    gone = deleted_lines(docs, id_col, text_col, min_words)
    key, lost = free_name(docs, "line_key"), free_name(docs, "line_numbers")
    told = gone.select(F.col("d.id").alias(f"{key}_d"), F.col("k").alias(f"{key}_k"), F.col("lines").alias(lost))
    own = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    joined = own.join(told, F.col(id_col).eqNullSafe(F.col(f"{key}_d")) & (F.col(key) == F.col(f"{key}_k")), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    cols = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if out:
        cols.append(F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(out))
    return joined.select(*cols)
