"""Every registered query with an oracle equals its DuckDB SQL on the same
Parquet tables (row count, column names, order-insensitive values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from wardstat.sources.tables import TABLES

from conftest import SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (f"{v:.6g}" if abs(v) >= 1e-6 else "0")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(ORACLE) >= 90


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(sdf.columns, s_rows) == rows_of(d_cols, d_rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["diag_1_category", "n", "rate"]
    assert df.count() > 0
