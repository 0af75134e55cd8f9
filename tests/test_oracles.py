"""Every query with an oracle gives the oracle's rows, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tabsplit.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if value is None or value is pd.NA or value != value:
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_are_the_oracles(spark, oracle, name):
    found = registry.queries()[name](spark, str(FOLDER)).toPandas()
    expected = oracle.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
