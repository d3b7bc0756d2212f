"""Streams over payloads made of the event table, replayed in three parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import hourly, placed, r6, secs, ticks
from barspark.catalog.sql import ATR, BARS
from barspark.operators import windows as V
from barspark.plans import strategies as G
from barspark.sources import tables
from barspark.sources.shared import shared_dir
from barspark.streaming import engine as E
from barspark.streaming import ingest as I

_SENT = """WITH RECURSIVE py AS (
  SELECT event_id * 10 + CASE WHEN event_id % 7 = 0 THEN 205 ELSE 0 END + k AS arrival, event_type AS symbol, (floor(epoch(ts) / 60) * 60000)::BIGINT AS ms, value AS v, CASE WHEN event_id % 13 = 0 THEN 'schema' WHEN event_type = 'error' THEN 'unknown_symbol' END AS reason
  FROM events, range(2) t(k) WHERE value IS NOT NULL AND NOT isnan(value) AND (k = 0 OR event_id % 10 = 0)),
ok AS (SELECT *, row_number() OVER (PARTITION BY symbol, ms ORDER BY arrival) AS n, first_value(v) OVER (PARTITION BY symbol, ms ORDER BY arrival) AS fv FROM py WHERE reason IS NULL),
ju AS (SELECT *, max(CASE WHEN n = 1 THEN ms END) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
st AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN v = fv THEN 'duplicate' ELSE 'conflict' END WHEN ms < before THEN 'out_of_order' ELSE 'accepted' END AS status FROM ju)"""


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines in arrival order: some late, some sent twice, some of another schema or an unknown symbol."""
    events = tables.table(spark, d, "events").where("value is not null and not isnan(value)")
    copies = events.withColumn("k", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    arrival = F.col("event_id") * 10 + F.when(F.col("event_id") % 7 == 0, 205).otherwise(0) + F.col("k")
    ms = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) * 60000).alias("bar_time_ms")
    price = [F.col("value").alias(c) for c in ("open", "high", "low", "close")]
    body = F.struct(arrival.alias("arrival"), F.when(F.col("event_id") % 13 == 0, "other").otherwise("bars.v1").alias("schema"), F.col("event_type").alias("symbol"), F.lit("1").alias("resolution"), ms, *price, F.lit(1.0).alias("volume"))
    return copies.select(arrival.alias("arrival"), F.to_json(body).alias("value"))


def replayed(spark: SparkSession, d: str) -> I.IngestConfig:
    """Replay the payloads in three parts; once for a session and a folder, as all queries here read the same stream."""
    done = getattr(spark, "_barspark_streams", None)
    if done is None:
        done = spark._barspark_streams = {}
    if d in done:
        return done[d]
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = payloads(spark, d)
    known = tables.table(spark, d, "events").where("event_type <> 'error'").select("event_type").distinct()  # a handful of kinds
    config = I.IngestConfig(root, tuple(sorted(r[0] for r in known.collect())))
    top = lines.agg(F.max("arrival")).first()[0] or 0
    for part in range(3):
        low, high = top * part // 3, top * (part + 1) // 3
        chosen = lines.where((F.col("arrival") > low) & (F.col("arrival") <= high)) if part else lines.where(F.col("arrival") <= high)
        chosen.select("value").write.text(f"{root}/incoming/part={part}")
        I.replay(spark, f"{root}/incoming", config, crossing_signals)
    done[d] = config
    return config


@query("r01_ingest_statuses", f"""{_SENT} SELECT arrival, symbol, ms AS bar_time_ms, status, CASE WHEN status = 'conflict' THEN 'ohlcv_mismatch' END AS reason FROM st UNION ALL SELECT arrival, symbol, ms, 'rejected', reason FROM py WHERE reason IS NOT NULL""")
def _(spark, d):
    config = replayed(spark, d)
    return I.events(spark, config).select("arrival", "symbol", "bar_time_ms", "status", "reason")


@query("r05_gaps_in_open_minutes", f"""{_SENT}, gp AS (SELECT symbol, ms, before + 60000 AS a, ms AS b FROM st WHERE status = 'accepted' AND before IS NOT NULL AND before + 60000 < ms),
mi AS (SELECT symbol, ms, to_timestamp(t / 1000) AT TIME ZONE 'UTC' AS t FROM (SELECT symbol, ms, unnest(range(a, least(b, a + 336 * 3600000), 60000)) AS t FROM gp)), et AS (SELECT *, (t AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM mi)
SELECT symbol, ms AS bar_time_ms, count(*) FILTER (WHERE hour(et) <> 17 AND isodow(CASE WHEN hour(et) >= 18 THEN et::DATE + 1 ELSE et::DATE END) <= 5) AS gap_minutes FROM et GROUP BY symbol, ms HAVING gap_minutes > 0""")
def _(spark, d):
    config = replayed(spark, d)
    return I.events(spark, config).where("gap_minutes > 0").select("symbol", "bar_time_ms", "gap_minutes")


def _closed(minutes: int) -> str:
    return f"""SELECT symbol, '{minutes // 60}H' AS timeframe, floor(epoch(et) / {minutes * 60})::BIGINT AS cell, count(*) AS n, arg_min(v, ms) AS open, max(v) AS high, min(v) AS low, arg_max(v, ms) AS close, max(et) AS last FROM ac GROUP BY symbol, cell"""


@query("r02_closed_bars", f"""{_SENT}, ac AS (SELECT *, ((to_timestamp(ms / 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM st WHERE status = 'accepted'), b AS ({_closed(60)} UNION ALL {_closed(240)}), l AS (SELECT *, lead(cell) OVER (PARTITION BY symbol, timeframe ORDER BY cell) AS nxt FROM b)
SELECT symbol, timeframe, cell, open, high, low, close, n::DOUBLE AS volume FROM l WHERE nxt IS NOT NULL OR epoch(last) + 60 >= (cell + 1) * CASE timeframe WHEN '1H' THEN 3600 ELSE 14400 END""")
def _(spark, d):
    config = replayed(spark, d)
    rows = I.Store(spark, config.root).read("closed", I.CLOSED).where("timeframe in ('1H', '4H')")
    local = F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("start")).cast("timestamp"))
    cell = F.floor(local / F.when(F.col("timeframe") == "1H", 3600).otherwise(14400))
    return rows.select("symbol", "timeframe", cell.alias("cell"), *I.FIELDS)


@query("r03_late_bars_are_stored", f"""{_SENT} SELECT symbol, count(*) AS bars, max(ms) AS last_ms, arg_max(v, ms) AS last_close FROM st WHERE status IN ('accepted', 'out_of_order') GROUP BY symbol""")
def _(spark, d):
    return I.ingest_status(spark, replayed(spark, d))


def crossing_signals(bars: DataFrame) -> DataFrame:
    frame = V.smoothed(bars, {"fast": ("close", 2 / 4, 1), "slow": ("close", 2 / 9, 1)})
    return G.crossings(frame, keep=True).select("symbol", "ts", "direction", "fresh")


@query("r06_stream_signals", f"""{_SENT}, ac AS (SELECT *, ((to_timestamp(ms / 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM st WHERE status = 'accepted'), b AS ({_closed(60)}), l AS (SELECT *, lead(cell) OVER (PARTITION BY symbol ORDER BY cell) AS nxt FROM b),
c AS (SELECT * FROM l WHERE nxt IS NOT NULL OR epoch(last) + 60 >= (cell + 1) * 3600), e AS (SELECT *, sign(list_reduce(list(close) OVER w, lambda a, b: a + 0.5 * (b - a)) - list_reduce(list(close) OVER w, lambda a, b: a + 2.0 / 9 * (b - a))) AS s FROM c WINDOW w AS (PARTITION BY symbol ORDER BY cell ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY symbol ORDER BY cell), 0) AS before FROM e) SELECT symbol, cell, CASE WHEN s > 0 AND before <= 0 THEN 1 WHEN s < 0 AND before >= 0 THEN -1 ELSE 0 END AS direction FROM p""")
def _(spark, d):
    config = replayed(spark, d)
    rows = I.Store(spark, config.root).read("signals", "symbol string, ts timestamp_ntz, direction int")
    local = F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts")).cast("timestamp"))
    return rows.select("symbol", F.floor(local / 3600).alias("cell"), "direction")


#: A model as it might be frozen: more of a stretch or a move, more of it to come.
FROZEN = E.Bundle((-1, 0, 1), ((-0.2, -8.0, -0.3), (0.1, 0.0, 0.0), (-0.2, 8.0, 0.3)), (-1.0, 0.05, 1.1), cost=6.0, point_value=2.0)


def in_parts(frame: DataFrame, at: str, root: str, parts: int = 3):
    """Write a table's rows in files by time, one after another, and give the folder; ``yield`` between, so that streams run meanwhile."""
    span = frame.agg(F.min(F.unix_seconds(F.col(at))).alias("a"), F.max(F.unix_seconds(F.col(at))).alias("b")).first()
    for i in range(parts):
        low, high = (span.a + (span.b - span.a) * k // parts for k in (i, i + 1)) if span.a is not None else (0, 0)
        seconds = F.unix_seconds(F.col(at))
        chosen = frame.where(((seconds > low) | F.lit(i == 0)) & (seconds <= high))
        chosen.coalesce(1).write.parquet(f"{root}/part={i}")
        yield root


_FRAME = f"""{ATR}, f0 AS (SELECT z.*, CASE WHEN pos >= 9 THEN close / avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) - 1 END AS stretch, (close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts)) / CASE WHEN atr > 0 THEN atr END AS move FROM z),
f1 AS (SELECT *, exp(-0.2 - 8.0 * stretch - 0.3 * move) AS a, exp(CASE WHEN stretch + move IS NOT NULL THEN 0.1 END) AS b, exp(-0.2 + 8.0 * stretch + 0.3 * move) AS c, 6.0 / (CASE WHEN atr > 0 THEN atr END * 2.0) AS hurdle FROM f0),
f2 AS (SELECT *, (1.1 * c + 0.05 * b - a) / (a + b + c) AS ev FROM f1), f3 AS (SELECT *, CASE WHEN ev > hurdle THEN 1 WHEN ev < -hurdle THEN -1 WHEN ev IS NOT NULL AND hurdle IS NOT NULL THEN 0 END AS raw FROM f2),
re AS (SELECT symbol, pos, CASE WHEN coalesce(raw, 0) <> 0 THEN raw ELSE 0 END AS fired, CASE WHEN coalesce(raw, 0) <> 0 THEN 3 ELSE -1 END AS rest, coalesce(raw, 0) AS before FROM f3 WHERE pos = 0
  UNION ALL SELECT r.symbol, r.pos, CASE WHEN r.pos > rest AND coalesce(r.raw, 0) <> 0 AND r.raw <> before THEN r.raw ELSE 0 END, CASE WHEN r.pos > rest AND coalesce(r.raw, 0) <> 0 AND r.raw <> before THEN r.pos + 3 ELSE rest END, coalesce(r.raw, 0) FROM re JOIN f3 r ON r.symbol = re.symbol AND r.pos = re.pos + 1),
fl AS (SELECT f3.*, fired, hour(et) * 60 + minute(et) AS t FROM f3 JOIN re USING (symbol, pos))
SELECT symbol, epoch(ts)::BIGINT AS ts, round(ev, 6) AS ev, round(atr, 6) AS atr, round(hurdle, 6) AS cost_hurdle, fired AS direction, (t >= 570 AND t < 690) OR (t >= 810 AND t < 960) AS entry_allowed, t + 60 >= 960 AS session_ending, NOT (((t >= 570 AND t < 690) OR (t >= 810 AND t < 960)) AND t + 60 < 960) AS off_hours FROM fl"""
_FLAGS = ("entry_allowed", "session_ending", "off_hours")


@query("r08_signal_engine", _FRAME)
def _(spark, d):
    """Three files of bars; the engine stops and starts again after each."""
    root = f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"
    bars = hourly(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), *I.FIELDS)
    for folder in in_parts(bars, "ts", f"{root}/bars"):
        found = E.run_engine(spark, folder, root, FROZEN)
    return found.select("symbol", secs(), r6("ev", "ev"), r6("atr", "atr"), r6("cost_hurdle", "cost_hurdle"), "direction", *_FLAGS)


@query("r09_frozen_frame", _FRAME)
def _(spark, d):
    found = E.frame(placed(spark, d), FROZEN)
    return found.select("symbol", secs(), r6("ev", "ev"), r6("atr", "atr"), r6("cost_hurdle", "cost_hurdle"), "direction", *_FLAGS)


def contract_of(column: str):
    return F.when(F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 864000) % 2 == 0, "A").otherwise("B").alias("contract")


@query("r11_contract_guard", f"""{BARS}, q AS (SELECT symbol, ts AS qts, price, CASE WHEN floor(epoch(ts) / 864000) % 2 = 0 THEN 'A' ELSE 'B' END AS qc FROM ticks), b AS (SELECT symbol, ts + INTERVAL 1 HOUR AS done, CASE WHEN floor(epoch(ts) / 864000) % 2 = 0 THEN 'A' ELSE 'B' END AS bc FROM bars),
m AS (SELECT b.symbol, done, bc, arg_max(qc, (qts, price)) AS qc FROM b LEFT JOIN q ON q.symbol = b.symbol AND qts <= done AND qts > done - INTERVAL 6 HOUR GROUP BY ALL) SELECT symbol, epoch(done)::BIGINT AS ts, bc AS bar_contract, qc AS quote_contract, coalesce(bc = qc, false) AS valid FROM m""")
def _(spark, d):
    root = f"{shared_dir(spark)}/guard-{uuid.uuid4().hex}"
    quotes = ticks(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("qts"), "price", contract_of("ts"))
    bars = hourly(spark, d).select("symbol", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).cast("timestamp").alias("done"), "close", contract_of("ts"))
    for one, other in zip(in_parts(quotes, "qts", f"{root}/quotes"), in_parts(bars, "done", f"{root}/bars")):
        found = E.run_guard(spark, one, other, root, late="2 hours")
    return found.select("symbol", secs("done"), "bar_contract", "quote_contract", "valid")
