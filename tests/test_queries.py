"""Every registered query runs on the smallest tables and gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from shelfmark import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOUND, SQL = queries.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(cell):
    if cell is None or (isinstance(cell, float) and math.isnan(cell)):
        return ""
    return f"{cell:.6g}" if isinstance(cell, float) else str(cell)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query(spark, duck, name):
    got = FOUND[name](spark, DATA)
    rows = got.collect()
    if name in SQL:
        cur = duck.execute(SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(got.columns)
        order = sorted(columns)
        want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall())
        assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want
