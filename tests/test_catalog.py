"""Every query of the bar engine that has SQL gives the SQL's rows."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from barspark import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return ""
        if isinstance(value, bool) or getattr(getattr(value, "dtype", None), "kind", "") == "b":
            return str(bool(value))
        if isinstance(value, (int, float)) or getattr(getattr(value, "dtype", None), "kind", "-") in "iuf":
            return f"{float(value):.9g}"
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    expected = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    """Most values are checked in test_features.py, test_models.py, test_folds.py and test_simulation.py; README names those that are not."""
    assert len(catalog.QUERIES[name](spark, SMALL).toPandas()) > 0
