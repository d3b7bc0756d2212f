"""The signal engine's keyed state against the whole table, and the contract guard with late quotes."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.catalog.bars import placed
from barspark.catalog.stream import FROZEN, in_parts
from barspark.streaming import engine as E

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    from barspark.sources.shared import written

    return written(placed(spark, SMALL), "bars")


@pytest.fixture(scope="module")
def bundle(spark, bars, tmp_path_factory):
    middle = bars.agg(F.expr("timestampadd(SECOND, cast((unix_seconds(cast(max(ts) as timestamp)) - unix_seconds(cast(min(ts) as timestamp))) / 2 as int), min(ts))")).first()[0]
    made = E.build_bundle(bars, middle, horizon=4, cost=1.0, point_value=2.0)
    path = f"file://{tmp_path_factory.mktemp('bundle')}/b"
    made.save(spark, path)
    assert E.Bundle.load(spark, path) == made
    # nothing after the cut is learned from
    cut = bars.where(F.col("ts") <= F.lit(middle))
    assert E.build_bundle(cut, middle, horizon=4, cost=1.0, point_value=2.0).returns == pytest.approx(made.returns)
    return made


def rows(frame):
    out = frame.select("symbol", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "ev", "atr", "cost_hurdle", "direction", "entry_allowed", "session_ending", "off_hours").toPandas()
    return out.sort_values(["symbol", "t"]).reset_index(drop=True)


@pytest.mark.parametrize("frozen", ["fitted", "fixed"])
def test_stream_with_restarts_equals_the_table(spark, bars, bundle, tmp_path, frozen):
    own = bundle if frozen == "fitted" else FROZEN
    stamped = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    for folder in in_parts(stamped, "ts", f"file://{tmp_path}/in", 4):
        found = E.run_engine(spark, folder, f"file://{tmp_path}/out", own)
    got, want = rows(found), rows(E.frame(bars, own))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
    assert (want["direction"] != 0).sum() > 5 and want["ev"].notna().sum() > 100


def test_state_does_not_grow():
    state = (0.0, 0, [], 0, -1)
    line = pd.DataFrame({"ts": range(5000), "high": [2.0 + i % 7 for i in range(5000)], "low": [1.0 + i % 5 for i in range(5000)], "close": [1.5 + i % 6 for i in range(5000)]})
    whole, out = E.advance(state, line, FROZEN)
    assert len(whole[2]) == E.MEAN_BARS and len(out) == 5000
    parts = []
    for low in range(0, 5000, 613):
        state, more = E.advance(state, line.iloc[low : low + 613], FROZEN)
        parts += more
    assert state == whole and parts == out


def test_late_quotes_within_and_beyond_the_watermark(spark, tmp_path):
    noon = datetime(2026, 6, 2, 12)
    at = lambda minutes: noon + timedelta(minutes=minutes)
    quotes = [
        [("m", at(-30), 1.0, "A"), ("m", at(50), 2.0, "A"), ("n", at(-500), 1.0, "A"), ("m", at(300), 3.0, "B")],
        [("m", at(295), 4.0, "A"), ("m", at(58), 9.0, "B"), ("m", at(400), 5.0, "B")],  # 5 minutes late is in time, four hours late is not
        [("m", at(900), 6.0, "B")],
    ]
    bars = [
        [("m", at(0), 1.0, "A"), ("m", at(60), 1.0, "A"), ("n", at(60), 1.0, "A"), ("m", at(300), 1.0, "B")],
        [("m", at(298), 1.0, "A"), ("m", at(400), 1.0, "A")],
        [("m", at(901), 1.0, "B")],
    ]
    for i in range(3):
        spark.createDataFrame(quotes[i], E.QUOTES).coalesce(1).write.parquet(f"file://{tmp_path}/q/part={i}")
        spark.createDataFrame(bars[i], E.DONE).coalesce(1).write.parquet(f"file://{tmp_path}/b/part={i}")
        found = E.run_guard(spark, f"file://{tmp_path}/q", f"file://{tmp_path}/b", f"file://{tmp_path}/out", within="2 hours", late="10 minutes")
    got = {(r.symbol, (r.done - noon).total_seconds() / 60): (r.bar_contract, r.quote_contract, r.valid) for r in found.collect()}
    assert got[("m", 0)] == ("A", "A", True)
    assert got[("m", 60)] == ("A", "A", True)  # the quote at 58 came beyond the watermark
    assert got[("n", 60)] == ("A", None, False)  # no quote within the bound: told once none can come
    assert got[("m", 298)] == ("A", "A", True)  # by the late quote at 295
    assert got[("m", 300)] == ("B", "B", True)
    assert got[("m", 400)] == ("A", "B", False)
    assert got[("m", 901)] == ("B", "B", True)


def test_guard_meets_quotes_in_cells_of_time(spark, tmp_path):
    """Quotes of the cell before a bar's count, those just at the bound do not."""
    noon = datetime(2026, 6, 2, 12)
    at = lambda minutes: noon + timedelta(minutes=minutes)
    spark.createDataFrame([("m", at(-1), 1.0, "A"), ("m", at(240), 1.0, "B"), ("m", at(900), 1.0, "B")], E.QUOTES).coalesce(1).write.parquet(f"file://{tmp_path}/q/part=0")
    spark.createDataFrame([("m", at(1), 1.0, "A"), ("m", at(359), 1.0, "B"), ("m", at(601), 1.0, "B"), ("m", at(900), 1.0, "B")], E.DONE).coalesce(1).write.parquet(f"file://{tmp_path}/b/part=0")
    found = E.run_guard(spark, f"file://{tmp_path}/q", f"file://{tmp_path}/b", f"file://{tmp_path}/out", within="6 hours", late="10 minutes")
    got = {(r.done - noon).total_seconds() / 60: (r.quote_contract, r.valid) for r in found.collect()}
    assert got == {1: ("A", True), 359: ("B", True), 601: (None, False), 900: ("B", True)}
