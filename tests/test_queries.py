"""Every registered query of the engine's own against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import flagship, image_queries  # noqa: F401  (registers its queries)
from lodestrata.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PAIRS = {"spread_scenes": (flagship.spread_scenes, flagship.SQL)} | {k: (own.QUERIES[k], own.SQL[k]) for k in own.SQL}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.5f}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query(spark, con, name):
    run, sql = PAIRS[name]
    df = run(spark, SF)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in res.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
