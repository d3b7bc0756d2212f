"""Quantile edges between equal values, and ranks of shifts that tie in all but their way."""

from datetime import datetime

import duckdb
import pandas as pd
import pytest

from barspark.plans import setups as P
from barspark.plans import stats as S


@pytest.mark.parametrize("values", [[0.955257988] * 2, [0.6] * 5 + [0.955257988] * 14, [0.51, 0.6431384849999999, 0.709330888, 0.9], [0.7]])
def test_quantile_cells_as_the_sql_has_them(spark, values):
    frame = pd.DataFrame({"v": values})
    expected = duckdb.sql("SELECT v, len(list_filter(e, lambda x: x < v)) AS cell FROM frame, (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM frame) ORDER BY v").fetchall()
    rows = spark.createDataFrame([("m", v) for v in values], "symbol string, v double")
    got = S.quantile_cells(rows, "v", 10, "symbol").orderBy("v").collect()
    assert [(r.v, r.cell) for r in got] == expected


@pytest.mark.parametrize("ways", [(1, -1), (-1, 1)])
def test_rank_does_not_depend_on_the_order_of_rows(spark, ways):
    bars = [("m", pos, datetime(2026, 1, 1, pos), 20.0 if pos == 4 else 10.0, 1.0 if pos == 4 else 5.0, 7.0) for pos in range(10)]
    bars = spark.createDataFrame(bars, "symbol string, pos int, ts timestamp_ntz, high double, low double, close double")
    found = spark.createDataFrame([("m", way, 4, 6, 8, "candidate", 0.0) for way in ways], "symbol string, way int, broken_pos int, level_pos int, sweep_pos int, state string, acceptance double").coalesce(1)
    got = {r.way: (r.rank, r.tied) for r in P.ranked_shifts(found, bars).collect()}
    assert got == {-1: (1, True), 1: (2, True)}
