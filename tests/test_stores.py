"""Providers, caches, append-only stores, logs and exports."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barspark.catalog.outcomes import check_features
from barspark.sources import stores, tables

START = datetime(2026, 1, 1, 9, 30)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("m", START + timedelta(minutes=5 * i), 100.0 + i, 100.5 + i, 99.5 + i, 100.2 + i, 1000.0) for i in range(24)]
    return spark.createDataFrame(rows, tables.BAR_SCHEMA)


def test_csv_provider(spark, bars, tmp_path):
    bars.drop("symbol").coalesce(1).write.option("header", True).csv(f"{tmp_path}/bars")
    get = stores.provider(spark, "csv", f"{tmp_path}/bars")
    assert get("m", "2026-01-01 09:35:00", "2026-01-01 09:50:00", 5).count() == 3
    quarter = get("m", "2026-01-01 09:30:00", "2026-01-01 10:00:00", 15).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in quarter] == [(100.0, 102.5, 99.5, 102.2, 3000.0), (103.0, 105.5, 102.5, 105.2, 3000.0)]
    with pytest.raises(ValueError):
        get("m", "2026-01-01 09:30:00", "2026-01-01 10:00:00", 1)
    with pytest.raises(ValueError):
        stores.provider(spark, "nowhere", "x")


def test_cache_asks_once(spark, bars, tmp_path):
    asked = []

    def source(symbol, start, end, minutes):
        asked.append((start, end))
        return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))

    get = stores.cached(spark, source, f"{tmp_path}/cache")
    assert get("m", "2026-01-01 09:30:00", "2026-01-01 10:30:00", 5).count() == 12
    assert get("m", "2026-01-01 09:40:00", "2026-01-01 10:00:00", 5).count() == 4 and len(asked) == 1
    assert get("m", "2026-01-01 09:40:00", "2026-01-01 11:00:00", 5).count() == 16 and len(asked) == 2


def test_append_keeps_the_first_write(spark, bars, tmp_path):
    path = f"{tmp_path}/store"
    assert {r.status for r in stores.append_new(bars.limit(3), path).collect()} == {"added"}
    changed = bars.withColumn("close", F.when(F.col("open") == 101.0, F.lit(101.4)).otherwise(F.col("close")))
    got = {r.ts: r.status for r in stores.append_new(changed, path).collect()}
    assert sorted(got.values()) == ["added"] * 21 + ["conflict"] + ["same"] * 2
    assert spark.read.parquet(path).count() == 24 and spark.read.parquet(path).where("close = 101.4").count() == 0


def test_logs_annotations_bundles_and_exports(spark, bars, tmp_path):
    stores.append_log(bars.limit(4), "bar", f"{tmp_path}/log")
    stores.append_log(bars.select("symbol").limit(1), "signal", f"{tmp_path}/log")
    assert tables.read_bars_jsonl(spark, f"{tmp_path}/log").count() == 4
    assert stores.read_log(spark, f"{tmp_path}/log", "signal", "symbol string").count() == 1
    notes = spark.createDataFrame([(1, "a", "take"), (1, "b", "pass"), (1, "a", "take")], "round int, scene_id string, decision string")
    assert stores.import_annotations(notes, f"{tmp_path}/notes") == 2
    assert stores.import_annotations(notes, f"{tmp_path}/notes") == 0
    stores.save_bundle(spark.createDataFrame([("m", [0.1, 0.2])], "symbol string, beta array<double>"), f"{tmp_path}/bundle", trained_until="2025-01-01")
    table, facts = stores.load_bundle(spark, f"{tmp_path}/bundle")
    assert table.first()["beta"] == [0.1, 0.2] and facts == {"trained_until": "2025-01-01"}
    orders = [("1", "m", True, 100.0, 98.0, 104.0, "TARGET", 2.0, 1, 3), ("2", "m", False, 100.0, 101.0, 97.0, "STOP", -1.0, 1, 2), ("3", "m", False, 100.0, 101.0, 97.0, "NO_FILL", None, None, None)]
    frame = spark.createDataFrame(orders, "id string, symbol string, is_long boolean, price double, stop double, target double, result string, realized double, fill long, final long")
    assert [(r.id, r.exit_price) for r in stores.trade_export(frame).collect()] == [("2", 101.0), ("1", 104.0)]
    stores.write_csv({"trades": frame}, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/trades").count() == 3


def test_outcomes_are_no_features(bars):
    with pytest.raises(ValueError):
        check_features(bars.withColumn("realized", F.lit(1.0)), ["open", "realized"])
    assert check_features(bars, ["open"]).columns == ["open"]


def test_parquet_provider(spark, bars, tmp_path):
    tables.write_bars(bars, f"{tmp_path}/bars")
    get = stores.provider(spark, "parquet", f"{tmp_path}/bars")
    got = get("m", "2026-01-01 09:30:00", "2026-01-01 10:00:00", 15).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(100.0, 102.5, 99.5, 102.2, 3000.0), (103.0, 105.5, 102.5, 105.2, 3000.0)]
    one = get("m", "2026-01-01 09:30:00", "2026-01-01 09:31:00", 5)
    assert one.count() == 1 and get("nobody", "2026-01-01 09:30:00", "2026-01-01 10:00:00", 5).count() == 0


def test_annotations_are_checked_and_the_newest_counts(spark, tmp_path):
    path = f"{tmp_path}/marks"
    note = dict(candidate_id="a", candidate_time=None, annotator="x", decisions=["REJECT", "NO_TRADE"], error_tags=None, note=None, confidence=0.5, would_execute=None, location_quality=None, reason_for_pass=[], created_at=datetime(2026, 1, 1))
    frame = lambda *changes: spark.createDataFrame([note | c for c in changes], stores.ANNOTATION)
    bad = {
        "decisions": [{"decisions": []}, {"decisions": None}, {"decisions": ["MAYBE"]}, {"decisions": ["LONG", None]}], "error_tags": [{"error_tags": ["bad"]}], "reason_for_pass": [{"reason_for_pass": ["bad"]}],
        "note": [{"error_tags": ["other"]}, {"reason_for_pass": ["other"], "note": " "}], "confidence": [{"confidence": 1.1}, {"confidence": float("nan")}], "location_quality": [{"location_quality": 0}, {"location_quality": 6}], "annotator": [{"annotator": " "}, {"annotator": None}],
    }
    for fault, changes in bad.items():
        assert [r.f for r in frame(*changes).select(stores.annotation_fault().alias("f")).collect()] == [fault] * len(changes)
    assert stores.latest_annotations(spark, path).count() == 0
    with pytest.raises(ValueError, match="decisions"):
        stores.append_annotations(frame({}, {"decisions": []}), path)
    assert stores.latest_annotations(spark, path).count() == 0
    stores.append_annotations(frame({}, {"candidate_id": "b", "error_tags": ["other"], "note": "why"}), path)
    stores.append_annotations(frame({"decisions": ["LONG"], "created_at": datetime(2026, 1, 2), "confidence": None}), path)
    got = {r.candidate_id: r for r in stores.latest_annotations(spark, path).collect()}
    assert (got["a"].decisions, got["a"].confidence, got["b"].note, len(got)) == (["LONG"], None, "why", 2)
