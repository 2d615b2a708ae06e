"""Every registered query against its SQL twin, on the smallest data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sirenlens.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _sortable(rows):
    return sorted(rows, key=lambda r: [(v is None, type(v).__name__, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in ORACLES, f"{name} has no SQL twin"
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = _sortable([tuple(r[c] for c in columns) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == _sortable([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()])
