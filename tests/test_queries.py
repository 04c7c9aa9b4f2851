"""Every registered query of the library's own operators against its SQL in DuckDB; entry; independence of the llm subpackage."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from streamworks import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()
@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_llm(tmp_path):
    """A copy without the subpackage, its tests and the pipeline still imports, registers the other queries and runs one of them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    copy = shutil.copytree(root, tmp_path / "copy", ignore=gone)
    code = (
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert len(q) > 80 and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate()\n"
        "assert e.entry(s).count() > 0\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
