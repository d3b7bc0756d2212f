"""Building bars: resampling on several clocks, expansion into minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.session import eastern, session_day


def _ohlcv(order: list[str], price: str = "price") -> list[Column]:
    at = F.struct(*order)
    return [F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum("volume").alias("volume")]


def bars_of_ticks(ticks: DataFrame, minutes: int = 60) -> DataFrame:
    """Bars labelled by their open time; empty buckets do not exist.  Ticks of one time count in ``seq`` order."""
    bucket = floor_utc("ts", minutes)
    return ticks.groupBy("symbol", bucket.alias("bucket")).agg(*_ohlcv(["ts", "seq"])).withColumnRenamed("bucket", "ts")


def floor_utc(ts: str, minutes: int) -> Column:
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60 * minutes))).cast("timestamp_ntz")


def floor_eastern(ts: str, minutes: int) -> Column:
    """Start of the bucket on the New York wall clock, as a New York wall time."""
    seconds = F.unix_seconds(eastern(F.col(ts)).cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60 * minutes))).cast("timestamp_ntz")


def _merge(order: str) -> list[Column]:
    return [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume")]


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars on UTC buckets, closed and labelled left."""
    return bars.groupBy("symbol", floor_utc("ts", minutes).alias("bucket")).agg(*_merge("ts")).withColumnRenamed("bucket", "ts")


def resample_eastern(bars: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars on New York wall-clock buckets."""
    return bars.groupBy("symbol", floor_eastern("ts", minutes).alias("bucket")).agg(*_merge("ts")).withColumnRenamed("bucket", "ts_et")


def session_bars(bars: DataFrame, weekly: bool = False) -> DataFrame:
    """One bar per trade date (18:00 to 17:00 New York) or per trading week; rows outside sessions drop out."""
    day = session_day(F.col("ts"))
    label = F.date_trunc("week", day).cast("date") if weekly else day
    return bars.withColumn("session", label).where("session is not null").groupBy("symbol", "session").agg(*_merge("ts"))


def expand_minutes(bars: DataFrame, minutes: int) -> DataFrame:
    """Minute bars that aggregate back to the given ones: open, high, low, close in that order."""
    last = minutes - 1
    k = F.col("k")
    path = F.when(k == 0, F.col("open")).when(k == 1, F.col("high")).when(k == 2, F.col("low")).otherwise(F.col("close"))
    before = F.when(k == 0, F.col("open")).when(k == 1, F.col("open")).when(k == 2, F.col("high")).when(k == 3, F.col("low")).otherwise(F.col("close"))
    rows = bars.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return rows.select(
        "symbol",
        (F.col("ts") + F.make_dt_interval(mins=k)).alias("ts"),
        before.alias("open"),
        F.greatest(before, path).alias("high"),
        F.least(before, path).alias("low"),
        path.alias("close"),
        F.when(k == last, F.col("volume") - F.floor(F.col("volume") / minutes) * last).otherwise(F.floor(F.col("volume") / minutes)).alias("volume"),
    )
