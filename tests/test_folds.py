"""Ordered folds and first passages, chunk by chunk, against plain loops."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from barspark.operators import firsthit as H
from barspark.operators import structure as D
from barspark.operators import windows as V
from barspark.plans import setups as U
from barspark.plans import simulation as P

START = datetime(2024, 1, 3, 15)


@pytest.fixture(scope="module")
def walk(spark):
    """Two symbols on a random walk, in Arrow batches of a few rows."""
    rng = random.Random(3)
    rows = []
    for symbol in ("a", "b"):
        price = 100.0
        for i in range(700):
            o = price
            price = max(5.0, price + rng.gauss(0, 1))
            rows.append((symbol, i, START + timedelta(hours=i), o, max(o, price) + rng.random(), min(o, price) - rng.random(), price, 1.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield spark.createDataFrame(rows, "symbol string, pos int, ts timestamp_ntz, open double, high double, low double, close double, volume double"), rows
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def series(rows, symbol):
    return [r for r in rows if r[0] == symbol]


def test_averages_go_on_from_chunk_to_chunk(walk):
    frame, rows = walk
    got = V.smoothed(frame, {"e": V.ema_spec("close", 20)}).orderBy("symbol", "pos").collect()
    for symbol in ("a", "b"):
        plain = pd.Series([r[6] for r in series(rows, symbol)]).ewm(span=20, adjust=False, min_periods=20).mean()
        own = [r.e for r in got if r.symbol == symbol]
        assert own[:19] == [None] * 19 or all(v is None or v != v for v in own[:19])
        assert own[19:] == pytest.approx(plain[19:].tolist())


def test_first_passages_have_no_horizon(walk):
    """Levels that are passed hundreds of bars later, or never."""
    frame, rows = walk
    rng = random.Random(5)
    points = [(s, k, rng.randrange(600), rng.choice([1, -1]), 100.0 + rng.uniform(-40, 40)) for s in ("a", "b") for k in range(80)]
    table = frame.sparkSession.createDataFrame(points, "symbol string, id int, since int, side int, level double")
    for strict in (True, False):
        got = {(r.symbol, r.id): r.hit_pos for r in H.first_beyond(table, frame, "since", strict=strict).collect()}
        far = 0
        for s, k, since, side, level in points:
            hit = next((r[1] for r in series(rows, s) if r[1] > since and (r[4] > level if side > 0 else r[5] < level)), None)
            assert got[s, k] == hit
            far += hit is not None and hit - since > 200
        assert far > 0
    inside = {(r.symbol, r.id): r.hit_pos for r in H.first_inside(table, frame, "since").collect()}
    for s, k, since, _, level in points:
        assert inside[s, k] == next((r[1] for r in series(rows, s) if r[1] >= since and r[5] <= level <= r[4]), None)


def test_sweeps_shifts_and_fills_beyond_two_hundred_bars(spark):
    """A high that is swept after 300 bars, a structure that breaks 100 bars later, a gap filled after 150."""
    closes = [100, 101, 105, 101, 100] + [97 + (i % 2) for i in range(20)] + [90, 88, 90, 92] + [95.0] * 300 + [104, 100] + [96.0] * 100 + [80.0] * 5
    rows = [("a", i, START + timedelta(hours=i), c, c + 0.5, c - 0.5, float(c), 1.0) for i, c in enumerate(map(float, closes))]
    top = 329
    rows[top] = ("a", top, rows[top][2], 100.0, 106.0, 99.0, 104.0, 1.0)
    frame = spark.createDataFrame(rows, "symbol string, pos int, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    pools = D.pools(D.pivots(frame), frame)
    swept = pools.where("kind = 1 and price = 105.5").first()
    assert swept.hit_pos == top and swept.swept
    shifts = D.shifts(pools, D.pivots(frame), frame).where("kind = 1 and price = 105.5").first()
    assert shifts.mss_pos is not None and shifts.mss_pos - top > 50
    gaps = {r.pos: r for r in D.gaps(frame).collect()}
    assert any(r.fill_pos is not None and r.fill_pos - r.pos > 50 for r in gaps.values())


def test_rising_edges(walk):
    frame, rows = walk
    from pyspark.sql import functions as F

    marked = frame.withColumn("direction", F.signum(F.col("close") - F.col("open")))
    got = {(r.symbol, r.ts) for r in P.rising_edge(marked, 3).collect()}
    for symbol in ("a", "b"):
        expected, before, last = set(), 0.0, -100
        for i, r in enumerate(series(rows, symbol)):
            side = (r[6] > r[3]) - (r[6] < r[3])
            if side and side != before and i - last > 3:
                expected.add((symbol, r[2]))
                last = i
            before = side
        assert {x for x in got if x[0] == symbol} == expected


def test_peak_confirmation(spark):
    steps = [(1, 1.0), (1, 2.0), (1, 1.5), (1, 3.0), (1, 1.0), (-1, 5.0), (1, 1.0), (1, 0.5), (None, 1.0), (-1, 2.0), (-1, 1.0)]
    frame = spark.createDataFrame([("a", START + timedelta(hours=i), d and float(d), s) for i, (d, s) in enumerate(steps)], "symbol string, ts timestamp_ntz, direction double, strength double")
    taken = [(r.ts - START).seconds // 3600 for r in P.peak_confirm(frame, 3).orderBy("ts").collect()]
    assert taken == [2, 7, 10] or taken == [2, 7]


def plain_book(rows, atr, ev, stop_atr, slip, commission):
    out, trade = [], None
    for i, r in enumerate(rows):
        o, h, l, c = r[3:7]  # noqa: E741
        if trade:
            d, at, entry, stop, leave = trade
            raw = None
            if (d > 0 and l <= stop) or (d < 0 and h >= stop):
                raw, why = (min(stop, o) if d > 0 else max(stop, o)), "stop"
            elif leave:
                raw, why = o, "reversal"
            elif d * ev[i] <= 0:
                trade = (d, at, entry, stop, True)
            if raw is not None:
                out.append((at, i, d, why, ((raw - d * slip - entry) * d - commission) / abs(entry - stop)))
                trade = None
        side = 1 if ev[i] > 1 else -1 if ev[i] < -1 else 0
        if trade is None and side:
            trade = (side, i, c + side * slip, c - side * stop_atr * atr, False)
    return out


def test_shadow_book(walk):
    from pyspark.sql import functions as F

    frame, rows = walk
    marked = frame.withColumn("atr", F.lit(2.0)).withColumn("ev", F.col("close") - F.col("open")).withColumn("direction", F.when(F.col("ev") > 1, 1).when(F.col("ev") < -1, -1).otherwise(0))
    got = P.shadow_book(marked, 1.5, 0.05, 0.1, 500).orderBy("symbol", "entry_ts").collect()
    for symbol in ("a", "b"):
        own = series(rows, symbol)
        expected = plain_book(own, 2.0, [r[6] - r[3] for r in own], 1.5, 0.05, 0.1)
        mine = [r for r in got if r.symbol == symbol]
        assert [(r.direction, r.reason, r.bars) for r in mine] == [(d, why, b - a) for a, b, d, why, _ in expected]
        assert [r.r for r in mine] == pytest.approx([x[4] for x in expected])


def test_backtest_does_not_depend_on_chunks(walk):
    from pyspark.sql import functions as F

    frame, _ = walk
    bars = frame.withColumn("atr", F.lit(2.0)).withColumn("direction", F.when(F.col("close") > F.col("open") + 1, 1.0).when(F.col("close") < F.col("open") - 1, -1.0))
    spark = frame.sparkSession
    results = []
    for size in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        folds = [P.backtest(bars, P.BacktestConfig(windows=((0, 1440),))), P.channel(bars, 1.0, 2.0, 0.05)]
        results.append([sorted(map(tuple, f.collect())) for f in folds])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    assert results[0] == results[1] and all(results[0])


def test_setups_reach_to_the_end(walk):
    """The chain's rows are whole: every gap lies in its displacement, every target beyond its entry."""
    frame, _ = walk
    rows = U.setups(frame).collect()
    assert rows
    for r in rows:
        assert r.sweep_pos + 2 <= r.formed_pos <= r.end_pos and r.broken_pos < r.sweep_pos
        assert r.target is None or (r.target - r.entry) * r.way > 0
