"""Every query of the numbered problems on the smallest tables, against its SQL where it has some."""

import math
import os
from collections import Counter

import duckdb
import pytest

from helixmill.llm import queries

DATA = os.environ.get("HELIXMILL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql:
        out = duck.sql(sql)
        at = [out.columns.index(c) for c in cols]
        assert sorted(out.columns) == cols
        assert got == Counter(tuple(canon(r[i]) for i in at) for r in out.fetchall())
    else:
        assert all(n == 1 for n in got.values())
