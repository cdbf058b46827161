import glob
import os

import duckdb
import pytest

from tests.conftest import DATA
from tidemark.plans.queries import QUERIES, SQL


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        found = duck.execute(SQL[name])
        at = [d[0] for d in found.description]
        assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    else:
        assert len(set(columns)) == len(columns)
