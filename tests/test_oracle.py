"""Each query with SQL against DuckDB on the same tables; the others run and give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from veldspar.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = [p.stem for p in sorted(Path(SF).glob("*.parquet"))]
ROWS_ONLY = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x + 0.0, 9) + 0.0
    return x if isinstance(x, (int, str, bool, type(None))) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    key = lambda r: [str(x) for x in r]
    a = sorted(([cell(r[c]) for c in sorted(cols)] for r in got.collect()), key=key)
    at = [cols.index(c) for c in sorted(cols)]
    b = sorted(([cell(r[i]) for i in at] for r in want.fetchall()), key=key)
    assert len(a) == len(b) and len(a)
    assert a == b


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count()
