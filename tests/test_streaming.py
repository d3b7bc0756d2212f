"""Ingest of minute bars: statuses, conflicts, late bars, gaps, larger bars, repeated batches."""

import json
from datetime import datetime, timezone

import pytest

from barspark.streaming import ingest as I

MINUTE = 60_000
START = int(datetime(2026, 6, 2, 14, 0, tzinfo=timezone.utc).timestamp() * 1000)  # 10:00 in New York, a Tuesday


def line(arrival, minute, price=100.0, symbol="m", **other):
    body = {"arrival": arrival, "token": "t", "schema": "bars.v1", "symbol": symbol, "resolution": "1", "bar_time_ms": START + minute * MINUTE, "open": price, "high": price + 1, "low": price - 1, "close": price + 0.5, "volume": 10.0}
    return json.dumps(body | other)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ingest"))
    config = I.IngestConfig(f"file://{root}", ("m", "n"), token="t", timeframes=("5m", "15m", "D"))
    step = I.ingest_batch(config)
    batches = [
        [line(1, 0), line(2, 1, 101.0), line(3, 1, 101.0), line(4, 1, 102.0), line(5, 3), line(6, 2), "no json", line(7, 4, schema="x"), line(8, 4, token="y"), line(9, 4, symbol="z"), line(10, 4, high=1.0), line(11, 4, resolution="5"), line(12, 4, close=None)],
        [line(20, 4, 104.0), line(21, 2, 100.0), line(22, 0, 9.0), line(23, 5), line(24, 7 * 60 + 10), line(25, 6, symbol="n")],
    ]
    for i, lines in enumerate(batches):
        frame = spark.createDataFrame([(x,) for x in lines], "value string")
        step(frame, i)
        if i == 1:
            step(frame, i)  # as after a failure
    return config


def test_statuses(spark, run):
    got = {r.arrival: (r.status, r.reason, r.gap_minutes) for r in I.events(spark, run).collect()}
    assert got.pop(None) == ("rejected", "auth", 0)
    assert {k: v[0] for k, v in got.items()} == {
        1: "accepted", 2: "accepted", 3: "duplicate", 4: "conflict", 5: "accepted", 6: "out_of_order", 7: "rejected", 8: "rejected", 9: "rejected", 10: "rejected", 11: "rejected", 12: "rejected",
        20: "accepted", 21: "duplicate", 22: "conflict", 23: "accepted", 24: "accepted", 25: "accepted",
    }
    assert [got[i][1] for i in (7, 8, 9, 10, 11, 12)] == ["schema", "auth", "unknown_symbol", "ohlc", "resolution", "fields"]
    assert got[5][2] == 1 and got[20][2] == 0
    assert got[24][2] == 7 * 60 - 6  # from 10:06 to 17:10, but trading stops at 17:00


def test_closed_bars_take_no_late_ones(spark, run):
    rows = {(r.timeframe, r.start): r for r in I.Store(spark, run.root).read("closed", I.CLOSED).where("symbol = 'm'").collect()}
    first = rows["5m", datetime(2026, 6, 2, 14, 0)]
    assert (first.open, first.high, first.low, first.close, first.volume) == (100.0, 105.0, 99.0, 104.5, 40.0)
    assert ("15m", datetime(2026, 6, 2, 14, 0)) in rows and ("D", datetime(2026, 6, 1, 22, 0)) not in rows
    assert {r.timeframe for r in I.Store(spark, run.root).latest("forming", I.FORMING, 9).where("symbol = 'n'").collect()} == {"5m", "15m", "D"}


def test_store_and_trail(spark, run):
    state = {r.symbol: (r.bars, r.last_ms) for r in I.ingest_status(spark, run).collect()}
    assert state == {"m": (7, START + (7 * 60 + 10) * MINUTE), "n": (1, START + 6 * MINUTE)}
    assert [r.arrival for r in I.events(spark, run, "accepted", 2).collect()] == [25, 24]


def test_signals_see_the_buffer_before_many_fresh_bars(spark, tmp_path):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    config = I.IngestConfig(f"file://{tmp_path}", ("m",), token="t", timeframes=("5m",), signal_timeframe="5m", buffer=3)
    seen = F.count("*").over(Window.partitionBy("symbol").orderBy("ts")).cast("int")
    step = I.ingest_batch(config, lambda bars: bars.select("symbol", "ts", seen.alias("direction"), "fresh"))
    for batch, minutes in enumerate([range(0, 25, 5), range(25, 50, 5)]):
        step(spark.createDataFrame([(line(m, m),) for m in minutes], "value string"), batch)
    rows = I.Store(spark, config.root).read("signals", "symbol string, ts timestamp_ntz, direction int").orderBy("ts").collect()
    # four closed bars, then five more behind the three of the buffer
    assert [r.direction for r in rows] == [1, 2, 3, 4, 4, 5, 6, 7, 8]


def test_copies_stay_out_of_the_line_of_a_symbol(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", 120, 1.0), (2, "m", 120, 1.0), (3, "m", 60, 1.0), (4, "m", 120, 2.0)], "arrival long, symbol string, bar_time_ms long, open double")
    rows = rows.select("*", *(rows.open.alias(c) for c in I.FIELDS[1:]))
    done = {r.arrival: (r.status, r.before_ms) for r in I.judged(rows, spark.createDataFrame([], I.BARS), spark.createDataFrame([("m", 30)], I.LAST)).collect()}
    assert done == {1: ("accepted", 30), 2: ("duplicate", None), 3: ("out_of_order", 120), 4: ("conflict", None)}


def test_stored_files_do_not_follow_the_days(spark, tmp_path):
    config = I.IngestConfig(f"file://{tmp_path}", ("m",), token="t", timeframes=("5m",))
    I.ingest_batch(config)(spark.createDataFrame([(line(d, d * 1440),) for d in range(40)], "value string"), 0)
    assert len(list(tmp_path.glob("bars/batch=0/**/*.parquet"))) <= 4
    assert I.Store(spark, config.root).read("bars", I.BARS).where("day = DATE'2026-06-03'").count() == 1
