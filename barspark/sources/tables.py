"""Readers, writers and the derivation of bars from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(events: DataFrame) -> DataFrame:
    """symbol, ts, seq, price and volume of an event table; events without a value are no ticks."""
    return events.where("value is not null and not isnan(value)").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume")
    )


def read_bars_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of a CSV file with a header, under an explicit schema; undated rows are dropped."""
    schema = "ts timestamp_ntz, open double, high double, low double, close double, volume double"
    return spark.read.csv(path, header=True, schema=schema).where("ts is not null").withColumn("symbol", F.lit(symbol))


def read_bars_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Bars of an append-only JSON log; other record types are skipped."""
    return spark.read.schema(f"record_type string, {BAR_SCHEMA}").json(path).where("record_type = 'bar'").drop("record_type")


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by symbol and sorted by time, so that filters on both prune files and row groups."""
    bars.repartition("symbol").sortWithinPartitions("ts").write.mode("overwrite").partitionBy("symbol").parquet(path)


def valid_bars(bars: DataFrame, arrival: str) -> DataFrame:
    """Required columns only, the last arrival of each (symbol, ts), rows that hold together as bars."""
    latest = Window.partitionBy("symbol", "ts").orderBy(F.col(arrival).desc())
    whole = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return bars.withColumn("at", F.row_number().over(latest)).where((F.col("at") == 1) & whole).select("symbol", "ts", *BAR_COLUMNS)


def native_minutes(bars: DataFrame) -> DataFrame:
    """Median spacing of each symbol's bars, in minutes."""
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(Window.partitionBy("symbol").orderBy("ts"))
    return bars.select("symbol", (gap / 60).alias("gap")).groupBy("symbol").agg(F.percentile("gap", F.lit(0.5)).alias("minutes"))


def covered(bars: DataFrame, start, end, interval: str):  # noqa: ANN001
    """Whether stored bars span a requested range, one interval beyond the last bar included."""
    return bars.groupBy("symbol").agg(((F.min("ts") <= F.lit(start)) & (F.max("ts") + F.expr(f"INTERVAL {interval}") >= F.lit(end))).alias("covered"))


def guarded(bars: DataFrame, split: str, boundary: str, allow_holdout: bool = False) -> DataFrame:
    """Rows of a split; reading beyond the development boundary needs explicit consent."""
    if split == "dev":
        return bars.where(F.col("ts") < F.lit(boundary).cast("timestamp_ntz"))
    if split not in ("holdout", "all"):
        raise ValueError(f"unknown split {split!r}")
    if not allow_holdout:
        raise PermissionError("reading the holdout needs allow_holdout=True")
    return bars if split == "all" else bars.where(F.col("ts") >= F.lit(boundary).cast("timestamp_ntz"))
