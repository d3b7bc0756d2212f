"""Path-dependent folds on a handful of bars, worked out by hand."""

from datetime import datetime, timedelta

import pytest

from barspark.plans import simulation, stats


@pytest.fixture(scope="module")
def bars(spark):
    start = datetime(2024, 1, 3, 15)  # 10:00 in New York
    rows = [  # open, high, low, close, direction
        (100.0, 101.0, 99.0, 100.0, 1.0),
        (100.0, 100.5, 99.5, 100.0, None),
        (100.0, 104.0, 99.5, 103.0, None),
        (103.0, 103.5, 102.0, 103.0, -1.0),
        (103.0, 107.0, 102.5, 106.0, None),
        (106.0, 106.5, 105.0, 106.0, None),
    ]
    data = [("a", start + timedelta(hours=i), *r[:4], 1.0, r[4]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, atr double, direction double")


def test_backtest_takes_target_then_stop(bars):
    config = simulation.BacktestConfig(slip=0.0, commission=0.0, point_value=1.0, most=1, windows=((0, 1440),))
    trades = simulation.backtest(bars, config).orderBy("entry_ts").collect()
    assert [(t.direction, t.entry, t.exit, t.reason) for t in trades] == [(1, 100.0, 102.25, "target"), (-1, 103.0, 104.5, "stop")]
    assert [t.r for t in trades] == pytest.approx([1.5, -1.0])


def test_backtest_costs_lower_the_result(bars):
    free = simulation.BacktestConfig(slip=0.0, commission=0.0, windows=((0, 1440),))
    dear = simulation.BacktestConfig(slip=0.1, commission=1.0, windows=((0, 1440),))
    best, worst = (simulation.backtest(bars, c).agg({"pnl": "sum"}).first()[0] for c in (free, dear))
    assert worst < best


def test_rising_edge_keeps_its_distance(bars):
    assert simulation.rising_edge(bars, 10).count() == 1
    assert simulation.rising_edge(bars, 1).count() == 2


def test_deflated_sharpe_falls_with_trials():
    few, many = (stats.deflated_sharpe(0.1, 500, 0.0, 3.0, t, 0.05) for t in (2, 200))
    assert 0 <= many < few <= 1
    assert stats.deflated_sharpe(0.1, 1, 0.0, 3.0, 2, 0.05) == 0.0
