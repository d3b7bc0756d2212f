"""Minute bars as a stream: from raw payloads to a checked store, larger bars and signals.

Every micro-batch goes through ordinary joins and windows against small state
tables (the last bar of each symbol, forming bars, a buffer of closed ones) and
against the days of the store that it touches.  All that a batch writes lies
under ``batch=<id>``, and a batch reads only what earlier ones wrote, so a batch
that is repeated after a failure writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.functions.session import eastern, session_day
from barspark.operators.bars import floor_eastern

PAYLOAD = "arrival long, token string, schema string, symbol string, resolution string, bar_time_ms long, open double, high double, low double, close double, volume double"
MINUTE = 60_000
#: Larger bars by name, in minutes of the New York clock; days and weeks follow the session calendar.
TIMEFRAMES = {"5m": 5, "15m": 15, "1H": 60, "4H": 240, "D": None, "W": None}
FIELDS = ["open", "high", "low", "close", "volume"]


@dataclass(frozen=True)
class IngestConfig:
    """``root`` is where the stream keeps its tables; ``token`` None accepts every payload; ``buffer`` bars of ``signal_timeframe`` are kept for signals."""

    root: str
    symbols: tuple[str, ...]
    token: str | None = None
    schema: str = "bars.v1"
    timeframes: tuple[str, ...] = tuple(TIMEFRAMES)
    signal_timeframe: str = "1H"
    buffer: int = 240


def parsed(lines: DataFrame, config: IngestConfig) -> DataFrame:
    """Payload columns and ``reason``, the first rule that a line breaks; null if none."""
    rows = lines.select(F.from_json("value", PAYLOAD).alias("p")).select("p.*")
    prices = [F.col(c) for c in FIELDS]
    whole = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    missing = F.col("bar_time_ms").isNull()
    for c in prices:
        missing = missing | c.isNull() | F.isnan(c)
    reason = F.when(F.lit(config.token is not None) & ~F.col("token").eqNullSafe(F.lit(config.token)), "auth")
    reason = reason.when(~F.col("schema").eqNullSafe(F.lit(config.schema)), "schema").when(~F.col("resolution").eqNullSafe(F.lit("1")), "resolution").when(missing, "fields")
    reason = reason.when(F.col("bar_time_ms") % MINUTE != 0, "time").when(~whole, "ohlc").when(~F.coalesce(F.col("symbol").isin(*config.symbols), F.lit(False)), "unknown_symbol")
    return rows.withColumn("reason", reason)


class Store:
    """Tables of a stream, each a folder of batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, name: str, batch: int, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _batches(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path)) if files.exists(path) else []

    def read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one, with the column ``batch``."""
        full = f"{schema}, batch long"
        if not self._batches(name):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(f"{self.root}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def latest(self, name: str, schema: str, before: int) -> DataFrame:
        """Rows of the newest batch before one."""
        earlier = [b for b in self._batches(name) if b < before]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={earlier[-1]}") if earlier else self.spark.createDataFrame([], schema)


BARS = "symbol string, bar_time_ms long, open double, high double, low double, close double, volume double, in_order boolean, day date"
LAST = "symbol string, last_ms long"
STATUS = "arrival long, symbol string, bar_time_ms long, status string, reason string, gap_minutes long"
CLOSED = "symbol string, timeframe string, start timestamp_ntz, open double, high double, low double, close double, volume double"
FORMING = f"{CLOSED}, end_ timestamp_ntz, last_close timestamp_ntz"


def utc(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def open_minutes(rows: DataFrame, first: str, last: str, key: list[str], most_hours: int = 336) -> DataFrame:
    """Trading minutes in [first, last) of each row, both in milliseconds; the calendar changes on whole hours only.

    Looks at ``most_hours`` at most, as far as two weeks.
    """
    hour = 60 * MINUTE
    until = F.least(F.col(last), F.col(first) + most_hours * hour)
    hours = rows.where(F.col(first) < F.col(last)).select(*key, F.col(first).alias("a_"), until.alias("b_"))
    hours = hours.withColumn("h_", F.explode(F.sequence(F.floor(F.col("a_") / hour), F.floor((F.col("b_") - 1) / hour)))).withColumn("h_", F.col("h_") * hour)
    inside = (F.least("b_", F.col("h_") + hour) - F.greatest("a_", "h_")) / MINUTE
    counted = F.when(session_day(utc(F.col("h_"))).isNotNull(), inside).otherwise(0)
    return hours.groupBy(*key).agg(F.sum(counted).cast("long").alias("gap_minutes"))


def judged(batch: DataFrame, stored: DataFrame, last: DataFrame) -> DataFrame:
    """Valid payloads with status: accepted, duplicate, conflict (the first write stays) or out_of_order; ``before_ms``: the symbol's newest bar at a first write."""
    same_bar = Window.partitionBy("symbol", "bar_time_ms").orderBy("arrival")
    values = F.struct(*FIELDS)
    rows = batch.withColumn("own_", values).withColumn("n_", F.row_number().over(same_bar)).withColumn("first_", F.first(values).over(same_bar))
    prior = stored.select("symbol", "bar_time_ms", values.alias("prior_"))
    rows = rows.join(prior, ["symbol", "bar_time_ms"], "left").withColumn("held_", F.coalesce("prior_", F.when(F.col("n_") > 1, F.col("first_"))))
    # only first writes move a symbol's newest bar or are judged by it: copies stay out of the one line that a symbol has
    line = Window.partitionBy("symbol").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    fresh = rows.where("held_ is null").select("arrival", "symbol", "bar_time_ms", *FIELDS).join(F.broadcast(last), "symbol", "left")
    fresh = fresh.withColumn("before_ms", F.greatest(F.max("bar_time_ms").over(line), F.col("last_ms"))).drop("last_ms")
    fresh = fresh.withColumn("status", F.when(F.col("bar_time_ms") < F.col("before_ms"), "out_of_order").otherwise("accepted"))
    copies = rows.where("held_ is not null").withColumn("before_ms", F.lit(None).cast("long")).withColumn("status", F.when(F.col("held_") == F.col("own_"), "duplicate").otherwise("conflict"))
    return fresh.unionByName(copies.select(*fresh.columns))


def bucketed(bars: DataFrame, timeframes: tuple[str, ...]) -> DataFrame:
    """Minute bars (symbol, bar_time_ms, prices) once for each timeframe, with the bucket's start and end in UTC; those outside sessions have no day or week."""
    ts = utc(F.col("bar_time_ms"))
    rows = bars.withColumn("ts", ts)
    day = session_day(F.col("ts"))
    to_utc = lambda c: F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), c)
    cells = []
    for name in timeframes:
        minutes = TIMEFRAMES[name]
        if minutes:
            start = floor_eastern("ts", minutes)
            stop = start + F.expr(f"INTERVAL '{minutes}' MINUTE")
        elif name == "D":
            start, stop = F.date_sub(day, 1).cast("timestamp_ntz") + F.expr("INTERVAL '18' HOUR"), day.cast("timestamp_ntz") + F.expr("INTERVAL '17' HOUR")
        else:
            monday = F.date_trunc("week", day).cast("date")
            start, stop = F.date_sub(monday, 1).cast("timestamp_ntz") + F.expr("INTERVAL '18' HOUR"), F.date_add(monday, 4).cast("timestamp_ntz") + F.expr("INTERVAL '17' HOUR")
        cells.append(F.struct(F.lit(name).alias("timeframe"), to_utc(start).alias("start"), to_utc(stop).alias("end_")))
    return rows.select("symbol", "ts", *FIELDS, F.explode(F.array(*cells)).alias("x")).select("symbol", "ts", *FIELDS, "x.*").where("start is not null")


def built(minutes: DataFrame, forming: DataFrame, timeframes: tuple[str, ...]) -> DataFrame:
    """Larger bars from forming ones and new minutes in order; ``closed``: complete, or followed by a later bucket."""
    new = bucketed(minutes, timeframes).withColumn("first_", F.col("ts")).withColumn("last_close", F.col("ts") + F.expr("INTERVAL '1' MINUTE"))
    # a forming bar's own open comes before any new minute
    old = forming.withColumn("first_", F.col("start") - F.expr("INTERVAL '1' MINUTE"))
    names = ["symbol", "timeframe", "start", "end_", *FIELDS, "first_", "last_close"]
    rows = old.select(*names).unionByName(new.select(*names))
    bars = rows.groupBy("symbol", "timeframe", "start", "end_").agg(
        F.min_by("open", "first_").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_close").alias("close"), F.sum("volume").alias("volume"), F.max("last_close").alias("last_close")
    )
    later = F.lead("start").over(Window.partitionBy("symbol", "timeframe").orderBy("start"))
    return bars.withColumn("closed", (F.col("last_close") >= F.col("end_")) | later.isNotNull())


Signals = Callable[[DataFrame], DataFrame]


def ingest_batch(config: IngestConfig, signals: Signals | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of raw lines goes through: parse, route, first write wins, order, gaps, store, larger bars, signals."""

    def run(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        store = Store(spark, config.root)
        # read once into the batch's own table: the source's lines are then the same for all that follows
        store.write("payloads", batch, parsed(lines, config))
        rows = spark.read.schema(f"{PAYLOAD}, reason string").parquet(f"{store.root}/payloads/batch={batch}")
        good = rows.where("reason is null").drop("reason", "token", "schema", "resolution")
        span = good.agg(F.to_date(utc(F.min("bar_time_ms"))).alias("a"), F.to_date(utc(F.max("bar_time_ms"))).alias("b")).first()
        stored = store.read("bars", BARS, batch)
        if span.a is not None:
            stored = stored.where(F.col("day").between(F.lit(span.a), F.lit(span.b)))  # only the touched days are read
        last = store.latest("last", LAST, batch)
        done = judged(good, stored, last)
        newest = done.where("status = 'accepted' and before_ms is not null").select("arrival", (F.col("before_ms") + MINUTE).alias("expected"), "bar_time_ms")
        gaps = open_minutes(newest, "expected", "bar_time_ms", ["arrival"])
        out = done.join(gaps, "arrival", "left").select("arrival", "symbol", "bar_time_ms", "status", F.when(F.col("status") == "conflict", "ohlcv_mismatch").alias("reason"), F.coalesce("gap_minutes", F.lit(0).cast("long")).alias("gap_minutes"), *FIELDS)
        bad = rows.where("reason is not null").select("arrival", "symbol", "bar_time_ms", F.lit("rejected").alias("status"), "reason", F.lit(0).cast("long").alias("gap_minutes"), *FIELDS)
        store.write("statuses", batch, out.unionByName(bad))
        known = spark.read.schema(f"{STATUS}, open double, high double, low double, close double, volume double").parquet(f"{store.root}/statuses/batch={batch}")
        kept = known.where("status in ('accepted', 'out_of_order')").select("symbol", "bar_time_ms", *FIELDS, (F.col("status") == "accepted").alias("in_order"), F.to_date(utc(F.col("bar_time_ms"))).alias("day"))
        # in order of days, so that files follow the rows' number, not the days', and statistics prune them
        store.write("bars", batch, kept.repartitionByRange("day", "bar_time_ms").sortWithinPartitions("day", "bar_time_ms"))
        heads = last.unionByName(kept.select("symbol", F.col("bar_time_ms").alias("last_ms"))).groupBy("symbol").agg(F.max("last_ms").alias("last_ms"))
        store.write("last", batch, heads)
        larger = built(kept.where("in_order"), store.latest("forming", FORMING, batch), config.timeframes)
        names = ["symbol", "timeframe", "start", *FIELDS]
        store.write("larger", batch, larger)
        larger = spark.read.schema(f"{FORMING}, closed boolean").parquet(f"{store.root}/larger/batch={batch}")
        store.write("closed", batch, larger.where("closed").select(*names))
        store.write("forming", batch, larger.where("not closed").drop("closed"))
        if signals is not None:
            fresh = larger.where(F.col("closed") & (F.col("timeframe") == config.signal_timeframe)).select(*names)
            # all that the buffer holds goes before the fresh bars, however many these are
            recent = store.latest("buffer", CLOSED, batch).withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
            found = signals(recent.withColumnRenamed("start", "ts"))
            store.write("signals", batch, found.where("fresh").drop("fresh"))
            newest = recent.withColumn("n_", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("start").desc()))).where(F.col("n_") <= config.buffer)
            store.write("buffer", batch, newest.drop("n_", "fresh"))

    return run


def replay(spark: SparkSession, source: str, config: IngestConfig, signals: Signals | None = None, files_per_batch: int | None = None) -> None:
    """Run all lines that are new under ``source`` through the same path as a live stream, then stop."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    writer = reader.load(source).writeStream.foreachBatch(ingest_batch(config, signals))
    writer.option("checkpointLocation", f"{config.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ingest_status(spark: SparkSession, config: IngestConfig) -> DataFrame:
    """symbol, bars (stored minutes), last_ms and last_close of each symbol."""
    bars = Store(spark, config.root).read("bars", BARS)
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("bar_time_ms").alias("last_ms"), F.max_by("close", "bar_time_ms").alias("last_close"))


def events(spark: SparkSession, config: IngestConfig, status: str | None = None, tail: int | None = None) -> DataFrame:
    """The trail of what happened to payloads, one kind of it or the last few."""
    rows = Store(spark, config.root).read("statuses", STATUS)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows if tail is None else rows.orderBy(F.col("arrival").desc()).limit(tail)
