"""Every query runs on the smallest tables; those with SQL give what DuckDB gives."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
# the pN queries are run by tests/llm
QUERIES, ORACLES = ({k: v for k, v in d.items() if not re.match(r"p\d+_", k)} for d in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def compared(spark, duck, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    rows = df.collect()
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        theirs = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == sorted(repr([plain(r[c]) for c in columns]) for r in theirs)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    compared(spark, duck, QUERIES[name], ORACLES.get(name))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_workers_get_the_package(tmp_path):
    """Also if the driver was started elsewhere, with the repository on its own path only."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()["html_main_text"](spark, {DATA!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
