"""Every registered query on the smallest tables, against its SQL where it has some."""

import json
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point

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


#: What every row of a query without SQL must hold.
HOLDS = {
    "generated_namespaces": lambda r: r["namespaces"] == 8 and -1e-9 <= r["least"] <= r["median"] <= r["most"],
    "coefficient_summary": lambda r: r["positive"] + r["negative"] + r["zero"] == r["fits"] and r["q25"] <= r["median"] <= r["q75"],
    "two_stage_bootstrap": lambda r: r["low"] <= r["median"] <= r["high"] and sum(json.loads(r["alphas"]).values()) == r["replicates"] <= 2000,
    "generated_fiber_gains": lambda r: -1e-9 <= r["own_least"] <= r["own_mean"] <= r["own_most"] and r["fibers"] > 0,
    "ridge_nested_cv": lambda r: r["least_alpha"] <= r["most_alpha"] and (r["r_squared"] is None or r["r_squared"] <= 1),
    "codec_encode_context": lambda r: (r["status"] == "encoded") == (r["seq"] is not None) and r["candidates"] == 1 << r["bits"],
    "bca_interval": lambda r: r["low"] <= r["high"],
}


@pytest.mark.parametrize("name", sorted(entry_point.plans.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = df.collect()
    got = Counter(tuple(canon(r[c]) for c in cols) for r in rows)
    if name in HOLDS:
        assert got and all(map(HOLDS[name], rows))
    sql = entry_point.oracle_sql().get(name)
    if sql:
        out = duck.sql(sql)
        at = [out.columns.index(c) for c in cols]
        assert sorted(out.columns) == cols
        assert got == Counter(tuple(canon(r[i]) for i in at) for r in out.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
