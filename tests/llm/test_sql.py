"""The operators' queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from lodestrata.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in res.description)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    want = sorted(tuple(str(dict(zip([d[0] for d in res.description], r, strict=True))[c]) for c in names) for r in res.fetchall())
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == want
