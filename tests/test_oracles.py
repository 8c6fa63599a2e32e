"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import corpus, forum

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(forum.ORACLE))
def test_same_rows(spark, duck, name):
    frame = forum.QUERIES[name](spark, FOLDER)
    want = duck.sql(forum.ORACLE[name])
    assert sorted(frame.columns) == sorted(want.columns)
    order = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(want.columns, r))) for r in want.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(forum.QUERIES) - set(forum.ORACLE)) + sorted(corpus.QUERIES))
def test_runs(spark, name):
    frame = {**forum.QUERIES, **corpus.QUERIES}[name](spark, FOLDER)
    assert frame.count() > 0 and not [k for _, k in frame.dtypes if k == "void"]
