"""Every registered retrieval query and job against its oracle SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from jobs import queries as jobs
from textquarry import queries as own

QUERIES, ORACLE_SQL = {**own.QUERIES, **jobs.QUERIES}, {**own.ORACLE_SQL, **jobs.ORACLE_SQL}
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    out = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    theirs = [tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
