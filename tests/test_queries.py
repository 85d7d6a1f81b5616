"""Every query that SQL can express, held against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quarry.plans.oracle import ORACLE
from quarry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 5)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    at = [found.index(c) for c in names]
    assert got == sorted((tuple(value(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
