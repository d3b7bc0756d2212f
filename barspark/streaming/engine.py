"""Signals of a frozen model over a stream of bars, and the guard that quotes and bars are of one contract.

The signal engine carries a small state for each symbol in Spark's keyed state
(an average, the last closes, the selector's memory), so what it holds does not
grow with the stream, and a restart goes on from the checkpoint.  ``frame`` is
the same computation over a whole table, by windows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barspark.functions.session import eastern, minute_of_day, within_any
from barspark.operators import windows as V

#: Bars that the features look back: the average of closes and the move.
MEAN_BARS, MOVE_BARS, ATR_BARS = 10, 5, 14
FEATURES = ("stretch", "move")


@dataclass(frozen=True)
class Bundle:
    """A model that does not change any more: for each class intercept and weights of FEATURES, and the class's mean return in units of ATR.

    ``cost`` is that of a round trip in money, ``debounce`` how many bars a signal
    rests after it fired, ``windows`` the minutes of the New York day in which
    entries are allowed and ``minutes`` a bar's length.
    """

    classes: tuple[int, ...]
    weights: tuple[tuple[float, ...], ...]
    returns: tuple[float, ...]
    cost: float
    point_value: float
    debounce: int = 3
    windows: tuple[tuple[int, int], ...] = ((570, 690), (810, 960))
    minutes: int = 60

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        held = json.loads(spark.read.text(path).first().value)
        tupled = lambda x: tuple(map(tupled, x)) if isinstance(x, list) else x
        return cls(**{k: tupled(v) for k, v in held.items()})


def featured(bars: DataFrame) -> DataFrame:
    """Bars with pos, atr and the features, null while their look-back is not full."""
    frame = V.with_atr(bars)
    mean = F.when(F.col("pos") >= MEAN_BARS - 1, F.avg("close").over(V.rows(-(MEAN_BARS - 1), 0)))
    return frame.withColumn("stretch", F.col("close") / mean - 1).withColumn("move", (F.col("close") - F.lag("close", MOVE_BARS).over(V.in_time())) / F.when(F.col("atr") > 0, F.col("atr")))


def build_bundle(bars: DataFrame, until, horizon: int, cost: float, point_value: float, penalty: float = 0.01, **other) -> Bundle:  # noqa: ANN001, ANN003
    """Fit on bars up to ``until`` (a timestamp): classes -1, 0, 1 by the sign of the move over ``horizon`` bars beyond half an ATR.

    Labels end before ``until`` too.  Weights are a multinomial logistic
    regression's; a class's return is the mean move of its bars in ATR.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    line = V.in_time()
    ahead = (F.lead("close", horizon).over(line) - F.col("close")) / F.col("atr")
    rows = featured(bars).withColumn("ahead", ahead).withColumn("known_", F.lead("ts", horizon).over(line))
    rows = rows.where((F.col("known_") <= F.lit(until)) & (F.col("atr") > 0)).dropna(subset=[*FEATURES, "ahead"])
    rows = rows.withColumn("label", F.when(F.col("ahead") > 0.5, 2.0).when(F.col("ahead") < -0.5, 0.0).otherwise(1.0))
    means = {r.label: r.m for r in rows.groupBy("label").agg(F.avg("ahead").alias("m")).collect()}  # three classes
    model = LogisticRegression(regParam=penalty, family="multinomial", maxIter=100).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    found = model.numClasses
    weights = [(float(model.interceptVector[i]), *map(float, model.coefficientMatrix.toArray()[i])) if i < found else (-30.0, *(0.0 for _ in FEATURES)) for i in range(3)]
    return Bundle((-1, 0, 1), tuple(weights), tuple(float(means.get(float(i), 0.0)) for i in range(3)), cost, point_value, **other)


def flagged(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """entry_allowed, session_ending and off_hours by the New York clock alone, so that a live bar has them at once."""
    minute = minute_of_day(eastern(F.col("ts")))
    allowed, late = within_any(minute, list(bundle.windows)), minute + bundle.minutes >= bundle.windows[-1][1]
    return rows.withColumn("entry_allowed", allowed).withColumn("session_ending", late).withColumn("off_hours", ~(allowed & ~late))


def frame(bars: DataFrame, bundle: Bundle) -> DataFrame:
    """symbol, ts, ev, atr, cost_hurdle, direction (0 where no signal fires) and session flags of every bar of a table."""
    from barspark.plans.simulation import rising_edge

    rows = featured(bars)
    z = [F.lit(w[0]) + sum((F.lit(x) * F.col(c) for x, c in zip(w[1:], FEATURES)), F.lit(0.0)) for w in bundle.weights]
    odds = [F.exp(x - F.greatest(*z)) for x in z]
    ev: Column = sum((o * r for o, r in zip(odds, bundle.returns)), F.lit(0.0)) / sum(odds, F.lit(0.0))
    rows = rows.withColumn("ev", ev).withColumn("cost_hurdle", F.when(F.col("atr") > 0, bundle.cost / (F.col("atr") * bundle.point_value)))
    known = F.col("ev").isNotNull() & F.col("cost_hurdle").isNotNull()
    raw = F.when(known, F.when(F.col("ev") > F.col("cost_hurdle"), 1.0).when(F.col("ev") < -F.col("cost_hurdle"), -1.0).otherwise(0.0))
    fired = rising_edge(rows.withColumn("direction", raw), bundle.debounce).select("symbol", "ts", F.col("direction").cast("int").alias("direction"))
    out = rows.select("symbol", "ts", "ev", "atr", "cost_hurdle").join(fired, ["symbol", "ts"], "left").fillna(0, ["direction"])
    return flagged(out, bundle)


CARRIED = "atr double, bars long, closes array<double>, before int, rests_until long"
SIGNAL = "symbol string, ts timestamp, ev double, atr double, cost_hurdle double, direction int"
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def advance(state: tuple, bars: pd.DataFrame, bundle: Bundle) -> tuple[tuple, list[tuple]]:
    """The next state and a signal row for each bar of one symbol, in order of time."""
    atr, n, closes, before, rests_until = state
    closes, out = list(closes), []
    weights = np.array(bundle.weights)
    for ts, high, low, close in zip(bars["ts"], bars["high"], bars["low"], bars["close"]):
        span = max(high - low, abs(high - closes[-1]), abs(low - closes[-1])) if closes else high - low
        atr = span if not n else atr + 2.0 / (ATR_BARS + 1) * (span - atr)
        closes = [*closes, close][-MEAN_BARS:]
        known, ev, hurdle = (atr if n >= ATR_BARS - 1 else None), None, None
        if known is not None and known > 0:
            x = np.array([1.0, close / (sum(closes) / MEAN_BARS) - 1, (close - closes[-1 - MOVE_BARS]) / known])
            z = weights @ x
            odds = np.exp(z - z.max())
            ev, hurdle = float(odds @ np.array(bundle.returns) / odds.sum()), bundle.cost / (known * bundle.point_value)
        raw = None if ev is None else 1 if ev > hurdle else -1 if ev < -hurdle else 0
        fires = bool(raw) and n > rests_until and raw != before
        rests_until = n + bundle.debounce if fires else rests_until
        before = raw or 0
        out.append((ts, ev, known, hurdle, raw if fires else 0))
        n += 1
    return (float(atr), n, [float(c) for c in closes], before, rests_until), out


class SignalProcessor(StatefulProcessor):
    """Carries one symbol's state over micro-batches: two averages' worth of numbers and MEAN_BARS closes, whatever the stream's length."""

    def __init__(self, bundle: Bundle):
        self.bundle = bundle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("carried", CARRIED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable")
        state = self.carried.get() if self.carried.exists() else (0.0, 0, [], 0, -1)
        state, out = advance(tuple(state), bars, self.bundle)
        self.carried.update(state)
        found = pd.DataFrame(out, columns=["ts", "ev", "atr", "cost_hurdle", "direction"])
        found.insert(0, "symbol", key[0])
        yield found.astype({"ev": float, "atr": float, "cost_hurdle": float, "direction": "int32"})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB for the queries started inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_engine(spark: SparkSession, source: str, root: str, bundle: Bundle, files_per_batch: int = 1) -> DataFrame:
    """Push all new bar files of ``source`` through the engine, in order, and read what it has ever written under ``root``.

    A run that is stopped and started again goes on behind its last finished batch.
    """
    with rocksdb(spark):
        bars = spark.readStream.schema(BARS).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(source)
        found = bars.groupBy("symbol").transformWithStateInPandas(SignalProcessor(bundle), SIGNAL, "append", "none")
        nan_free = found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("ev", "atr", "cost_hurdle")})
        writer = flagged(nan_free, bundle).writeStream.format("parquet").option("path", f"{root}/signals").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/signals")


# --- quotes and bars of one contract

QUOTES = "symbol string, qts timestamp, price double, contract string"
DONE = "symbol string, done timestamp, close double, contract string"


def interval_seconds(text: str) -> float:
    """Length of an interval such as ``6 hours``."""
    amount, unit = text.split()
    return pd.Timedelta(float(amount), unit.rstrip("s")).total_seconds()


def run_guard(spark: SparkSession, quotes: str, bars: str, root: str, within: str = "6 hours", late: str = "10 minutes", files_per_batch: int = 1) -> DataFrame:
    """Join two file streams, finished bars with the quotes of the ``within`` before them, and judge each bar by its newest quote.

    Both sides are kept only as long as the watermark, ``late`` behind the newest
    row, and the bound of the join ask for; quotes that come later are dropped.  A
    bar without any quote comes out once none can come any more.  Returns symbol,
    done, bar_contract, quote_contract and valid.
    """
    read = lambda path, schema, at: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path).withWatermark(at, late)
    q = read(quotes, QUOTES, "qts").select(F.col("symbol").alias("quote_symbol"), "qts", "price", F.col("contract").alias("quote_contract"))
    b = read(bars, DONE, "done").select("symbol", "done", F.col("contract").alias("bar_contract"))
    # both sides meet in cells of time as long as the bound: a bar looks into its own and the one before, not at all of its symbol
    width = F.lit(interval_seconds(within))
    q = q.withColumn("quote_cell", F.floor(F.unix_seconds("qts") / width))
    own = F.floor(F.unix_seconds("done") / width)
    b = b.withColumn("cell", F.explode(F.array(own, own - 1)))
    met = b.join(q, F.expr(f"quote_symbol = symbol AND quote_cell = cell AND qts <= done AND qts > done - INTERVAL {within}"), "left_outer")
    with rocksdb(spark):
        writer = met.select("symbol", "done", "bar_contract", "qts", "price", "quote_contract").writeStream.format("parquet").option("path", f"{root}/pairs").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return judged_bars(spark.read.parquet(f"{root}/pairs"))


def judged_bars(pairs: DataFrame) -> DataFrame:
    """One row for each bar: the contract of its newest quote and whether it is the bar's."""
    newest = pairs.groupBy("symbol", "done", "bar_contract").agg(F.max_by("quote_contract", F.struct("qts", "price")).alias("quote_contract"))
    return newest.withColumn("valid", F.coalesce(F.col("bar_contract") == F.col("quote_contract"), F.lit(False)))
