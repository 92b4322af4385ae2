"""Every query with an oracle against DuckDB, on the smallest tables."""

from collections.abc import Mapping
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from testdata import SF

from quarry.plans import catalog, surface  # noqa: F401


def plain(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 5)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, Mapping):
        return tuple(map(plain, v.values()))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    cols = sorted(df.columns)
    own = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [result.columns.index(c) for c in cols]
    other = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert own == other


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
