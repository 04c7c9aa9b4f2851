"""The Merkle manifest against a plain model over lists, its SQL, and awkward rows."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from streamworks.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, pos long"


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row: dict, text: str | None) -> str:
    cells = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in cells))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        start = i - i % 3
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 3])))
        i //= 3
    return out


def model(rows: list[dict]) -> list[tuple]:
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in by[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, (d, own, r) in enumerate(by[s]):
            text, proof = r["text"], path(trees[s], i) + path(top, j)
            if d is not None and text is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for before, after in proof:
                node = digest(before + node + after)
            out.append((d, own, trees[s][-1][0], top[-1][0], digest("".join(b + a for b, a in proof)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def same(df, rows, height=merkle.HEIGHT):
    got = merkle.checked_manifest(df, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == model(rows)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_the_model(spark, sf, height):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    same(df, [r.asDict() for r in df.collect()], height)


def test_query_equals_sql(spark, sf):
    got = queries.op12_merkle(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op12_merkle"]).fetchdf()
    assert got.columns == list(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False)))
    assert 0 < sum(want.verified) < len(want)  # some rows were tampered with, and those alone fail


def test_awkward_rows(spark):
    rows = [
        (1, "a", "en", 3, "x\ny", "l", 1), (1, "a", "en", 3, "x\nz", "l", 1), (None, "a", None, None, None, None, None), (2**60 + 1, "a", "en", 0, "", "l", 0),
        (3, None, "de", 5, "größe\n", "l", 2), (3, None, "de", 5, "größe\n", "l", 2), (-4, "", "en", 1, "\n\n", "l", 3), (5, "é", "en", 1, "long " * 50_000, "l", 3),
        *((i, "hot", "en", 2, f"{i}\n{i}", "l", i) for i in range(100, 300)), *((7, "copies", "en", 1, "same\n", "l", 1) for _ in range(40)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for height in (2, 6):
        same(df, [r.asDict() for r in df.collect()], height)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 27, 28, 82])
def test_sizes_around_a_superblock(spark, n):
    """A lone leaf is its subroot and root; one node more than a full block makes a run of one."""
    rows = [(i, "s", "en", 1, f"t\n{i}", None, None) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(df, [r.asDict() for r in df.collect()], 3) if n else None
    assert merkle.checked_manifest(df, 3).count() == n


def test_every_row_its_own_source(spark):
    rows = [(i, f"s{i}", "en", 1, f"t\n{i}", None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(df, [r.asDict() for r in df.collect()], 2)


def test_proofs_come_along(spark):
    """The operator's own output carries siblings that fold to the root, by functions of Spark as well."""
    rows = [(i, "ab"[i % 2], "en", 1, f"t{i}", None, None) for i in range(30)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), height=2)
    step = lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256)
    folded = got.select("id", "root", F.aggregate(F.arrays_zip("before", "after"), F.col("leaf"), step).alias("mine"), "folded_root").collect()
    assert len(folded) == 30 and all(r.root == r.mine == r.folded_root for r in folded)


def test_no_task_holds_a_hot_source(spark):
    """Positions of one source come from several ranges, and superblocks bound every group."""
    docs = spark.range(0, 4000, numPartitions=8).select(F.lit("s").alias("tree"), F.col("id"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("node"))
    got = merkle.numbered(docs, ["id"])
    assert got.select("pos", "id", "count").orderBy("pos").collect() == [(i, i, 4000) for i in range(4000)]
