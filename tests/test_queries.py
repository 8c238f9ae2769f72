"""Each query against the SQL that must give the same rows, on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()
OWN = {k for k in QUERIES if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return db


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: "NaN" if isinstance(x, float) and math.isnan(x) else f"{x + 0.0:.6g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir), duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(OWN - set(SQL)))
def test_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).collect()


def test_entry(spark, sf_dir):
    assert driver.entry(spark).count() > 0
