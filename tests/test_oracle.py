"""Every catalogued query against its DuckDB twin on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _rows(cols, rows):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    return sorted((tuple(_canon(r[i]) for i in idx) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(q for q in entry.oracle_sql() if q.startswith("q_")))
def test_query_matches_oracle(spark, duck, name):
    sql = entry.oracle_sql()[name]
    sdf = entry.queries()[name](spark, SF_SMALL)
    rel = duck.sql(sql)
    dcols, drows = list(rel.columns), rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["variant", "n", "mean_reward", "min_reward", "max_reward"]
    assert len(rows) >= 1


def test_every_catalogued_query_has_a_twin():
    assert {q for q in entry.queries() if q.startswith("q_")} == {q for q in entry.oracle_sql() if q.startswith("q_")}
