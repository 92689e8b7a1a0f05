"""Every registered query against its DuckDB oracle (sf0.001: small, fast)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    srows = [r.asDict() for r in sdf.collect()]
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    drows = [dict(zip(cols, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(cols)
    key = sorted(cols)
    a = sorted(tuple(_norm(r[c]) for c in key) for r in srows)
    b = sorted(tuple(_norm(r[c]) for c in key) for r in drows)
    assert a == b


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "count" in df.columns


def test_every_query_has_callable():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
