"""The queries of the llm operators that SQL can express, held against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from quarry.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from quarry.session import ship  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](ship(spark), SF)
    result = con.execute(ORACLE_SQL[name])
    names, found = sorted(df.columns), [d[0] for d in result.description]
    assert sorted(found) == names
    want = sorted((tuple(r[found.index(c)] for c in names) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want
