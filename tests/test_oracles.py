"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from curbflow.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    heads = [d[0] for d in result.description]
    assert sorted(heads) == columns
    theirs = sorted((tuple(plain(r[heads.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs
    assert ours or name in ("biweekly_best",)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert isinstance(datetime.date.today(), datetime.date) and set(entry.oracle_sql()) <= set(entry.queries())
