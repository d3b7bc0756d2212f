"""Scans, clocks, windows and joins over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.sql import ATR, BARS, POS, QUARTERS, TICKS
from barspark.functions import scalars as S
from barspark.functions import session as T
from barspark.operators import bars as B
from barspark.operators import joins as J
from barspark.operators import windows as V
from barspark.sources import tables


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ticks(tables.table(spark, sf_dir, "events"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_of_ticks(ticks(spark, sf_dir), 60)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with their position."""
    return hourly(spark, sf_dir).withColumn("pos", V.position())


def with_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_atr(placed(spark, sf_dir))


def secs(column: str = "ts"):
    return F.unix_seconds(F.col(column).cast("timestamp")).alias("ts")


def r6(column, name: str | None = None):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6).alias(name) if name else F.round(column, 6)


KEY = "symbol, epoch(ts)::BIGINT AS ts"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with span-14 ATR, span-20 EMA and session VWAP."""
    frame = placed(spark, sf_dir).withColumn("tr", V.true_range()).withColumn("vwap", V.session_vwap())
    frame = V.smoothed(frame, {"atr": V.ema_spec("tr", 14), "ema": V.ema_spec("close", 20)})
    return frame.select("symbol", secs(), "open", "high", "low", "close", "volume", r6("atr", "atr"), r6("ema", "ema"), r6("vwap", "vwap"))


query("flagship", f"""{ATR}
SELECT {KEY}, open, high, low, close, volume, round(atr, 6) AS atr,
  CASE WHEN pos >= 19 THEN round(list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, b: a + 2.0 / 21 * (b - a)), 6) END AS ema,
  round(sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0), 6) AS vwap
FROM z WINDOW d AS (PARTITION BY symbol, et::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)
""")(flagship)


@query("g01_resample_1h", f"{BARS} SELECT {KEY}, open, high, low, close, volume FROM bars")
def _(spark, d):
    return hourly(spark, d).select("symbol", secs(), *tables.BAR_COLUMNS)


@query("g01_resample_4h_of_1h", f"""{BARS}
SELECT symbol, floor(epoch(ts) / 14400)::BIGINT * 14400 AS ts, first(open ORDER BY bars.ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bars.ts) AS close, sum(volume) AS volume
FROM bars GROUP BY symbol, floor(epoch(ts) / 14400)""")
def _(spark, d):
    return B.resample(hourly(spark, d), 240).select("symbol", secs(), *tables.BAR_COLUMNS)


@query("g02_resample_eastern_4h", f"""{POS}
SELECT symbol, floor(epoch(et) / 14400)::BIGINT * 14400 AS ts, first(open ORDER BY x.ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY x.ts) AS close, sum(volume) AS volume
FROM x GROUP BY symbol, floor(epoch(et) / 14400)""")
def _(spark, d):
    return B.resample_eastern(hourly(spark, d), 240).select("symbol", secs("ts_et"), *tables.BAR_COLUMNS)


_SESSION = f"""{POS}, s AS (
  SELECT *, CASE WHEN hour(et) >= 18 THEN et::DATE + 1 ELSE et::DATE END AS sd FROM x WHERE hour(et) <> 17
), session AS (SELECT * FROM s WHERE isodow(sd) <= 5)"""


@query("f07_session_day_bars", f"""{_SESSION}
SELECT symbol, sd::VARCHAR AS session, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM session GROUP BY symbol, sd""")
def _(spark, d):
    return B.session_bars(hourly(spark, d)).withColumn("session", F.col("session").cast("string"))


@query("f08_session_week_bars", f"""{_SESSION}
SELECT symbol, date_trunc('week', sd)::DATE::VARCHAR AS session, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM session GROUP BY symbol, date_trunc('week', sd)""")
def _(spark, d):
    return B.session_bars(hourly(spark, d), weekly=True).withColumn("session", F.col("session").cast("string"))


@query("s02_valid_bars", """
WITH r AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, value AS close, event_id FROM events WHERE value IS NOT NULL)
SELECT symbol, epoch(ts)::BIGINT AS ts, arg_max(close, event_id) AS close FROM r GROUP BY symbol, ts""")
def _(spark, d):
    raw = ticks(spark, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    raw = raw.select("symbol", "ts", "seq", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), "volume")
    return tables.valid_bars(raw, "seq").select("symbol", secs(), "close")


@query("s03_native_minutes", f"""{BARS}, g AS (SELECT symbol, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 60 AS gap FROM bars)
SELECT symbol, quantile_cont(gap, 0.5) AS minutes FROM g GROUP BY symbol""")
def _(spark, d):
    return tables.native_minutes(hourly(spark, d))


@query("s08_coverage", f"""{BARS} SELECT symbol, min(ts) <= TIMESTAMP '2024-01-01 06:00:00' AND max(ts) + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-29 00:00:00' AS covered FROM bars GROUP BY symbol""")
def _(spark, d):
    from datetime import datetime

    return tables.covered(hourly(spark, d), datetime(2024, 1, 1, 6), datetime(2024, 1, 29), "1 HOUR")


@query("s10_dev_split", f"{BARS} SELECT symbol, count(*) AS n FROM bars WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY symbol")
def _(spark, d):
    return tables.guarded(hourly(spark, d), "dev", "2024-01-20 00:00:00").groupBy("symbol").agg(F.count("*").alias("n"))


@query("s19_expand_minutes", f"""{BARS}, m AS (
  SELECT b.symbol, epoch(b.ts)::BIGINT + 60 * k AS ts, k, volume, open AS o, high AS h, low AS l, close AS c FROM bars b, range(60) t(k)
)
SELECT symbol, ts,
  CASE WHEN k <= 1 THEN o WHEN k = 2 THEN h WHEN k = 3 THEN l ELSE c END AS open,
  CASE k WHEN 0 THEN o WHEN 1 THEN h WHEN 2 THEN h WHEN 3 THEN greatest(l, c) ELSE c END AS high,
  CASE k WHEN 0 THEN o WHEN 1 THEN o WHEN 2 THEN l WHEN 3 THEN least(l, c) ELSE c END AS low,
  CASE k WHEN 0 THEN o WHEN 1 THEN h WHEN 2 THEN l ELSE c END AS close,
  CASE WHEN k = 59 THEN volume - floor(volume / 60) * 59 ELSE floor(volume / 60) END AS volume
FROM m""")
def _(spark, d):
    return B.expand_minutes(hourly(spark, d), 60).select("symbol", secs(), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))


@query("f01_within_windows", f"""{POS} SELECT {KEY}, (hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 690) OR (hour(et) * 60 + minute(et) >= 900 AND hour(et) * 60 + minute(et) < 960) AS inside FROM x""")
def _(spark, d):
    minute = T.minute_of_day(T.eastern(F.col("ts")))
    return hourly(spark, d).select("symbol", secs(), T.within_any(minute, [(570, 690), (900, 960)]).alias("inside"))


@query("f03_active_sessions", f"""{POS}, m AS (SELECT *, hour(et) * 60 + minute(et) AS t FROM x)
SELECT {KEY}, concat_ws(',', CASE WHEN t >= 1080 THEN 'asia' END, CASE WHEN t >= 120 AND t < 300 THEN 'london_active' END, CASE WHEN t >= 510 AND t < 660 THEN 'ny_am' END, CASE WHEN t >= 810 AND t < 960 THEN 'ny_pm' END) AS sessions,
  CASE WHEN t >= 120 AND t < 300 THEN 'london' WHEN t >= 510 AND t < 660 THEN 'ny_am' WHEN t >= 810 AND t < 960 THEN 'ny_pm' END AS killzone FROM m""")
def _(spark, d):
    return hourly(spark, d).select("symbol", secs(), F.concat_ws(",", T.active_sessions(F.col("ts"))).alias("sessions"), T.killzone(F.col("ts")).alias("killzone"))


@query("f05_annotate_session", f"""{POS}, m AS (SELECT *, hour(et) * 60 + minute(et) AS t FROM x)
SELECT {KEY}, et::DATE::VARCHAR AS et_date, t >= 570 AND t < 960 AS in_rth, t >= 600 AND t <= 925 AS forecast_eligible, t >= 600 AND t < 900 AS entry_eligible, t >= 955 AND t < 960 AS force_flat FROM m""")
def _(spark, d):
    local = T.eastern(F.col("ts"))
    t = T.minute_of_day(local)
    return hourly(spark, d).select("symbol", secs(), F.to_date(local).cast("string").alias("et_date"), T.in_window(t, 570, 960).alias("in_rth"), ((t >= 600) & (t <= 925)).alias("forecast_eligible"), T.in_window(t, 600, 900).alias("entry_eligible"), T.in_window(t, 955, 960).alias("force_flat"))


@query("f09_open_minutes", f"""{POS}, g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars),
gaps AS (SELECT * FROM g WHERE ts - before > INTERVAL 4 HOUR),
m AS (SELECT symbol, ts, unnest(generate_series(before, ts - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t FROM gaps),
e AS (SELECT *, (t AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM m)
SELECT {KEY}, count(*) FILTER (WHERE hour(et) <> 17 AND isodow(CASE WHEN hour(et) >= 18 THEN et::DATE + 1 ELSE et::DATE END) <= 5) AS open_minutes FROM e GROUP BY symbol, ts""")
def _(spark, d):
    gaps = hourly(spark, d).select("symbol", "ts", F.lag("ts").over(V.in_time()).alias("before")).where("ts - before > INTERVAL '4' HOUR")
    minutes = gaps.withColumn("t", F.explode(F.expr("sequence(before, ts - INTERVAL '1' MINUTE, INTERVAL '1' MINUTE)")))
    return minutes.groupBy("symbol", "ts").agg(F.count_if(T.session_day(F.col("t")).isNotNull()).alias("open_minutes")).select("symbol", secs(), "open_minutes")


@query("f10_candles", f"""{POS}, c AS (SELECT *, abs(close - open) AS b, least(open, close) - low AS lw, high - greatest(open, close) AS uw FROM x)
SELECT {KEY}, coalesce(pc < po AND close > open AND close >= po AND open <= pc, false) AS engulfs_up, coalesce(pc > po AND close < open AND close <= po AND open >= pc, false) AS engulfs_down,
  b > 0 AND lw >= 2.0 * b AND uw <= 0.33 * b AS hammer, b > 0 AND uw >= 2.0 * b AND lw <= 0.33 * b AS star, high - low > 0 AND b <= 0.1 * (high - low) AS doji FROM c""")
def _(spark, d):
    po, pc = F.lag("open").over(V.in_time()), F.lag("close").over(V.in_time())
    frame = hourly(spark, d).withColumn("po", po).withColumn("pc", pc)
    up, down = (F.coalesce(f(F.col("po"), F.col("pc")), F.lit(False)) for f in (S.engulfs_up, S.engulfs_down))
    return frame.select("symbol", secs(), up.alias("engulfs_up"), down.alias("engulfs_down"), S.hammer().alias("hammer"), S.shooting_star().alias("star"), S.doji().alias("doji"))


@query("f15_exhaustion_wick", f"""{POS}, c AS (SELECT *, sign(lag(close, 1) OVER w - lag(close, 4) OVER w) AS trend FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT {KEY}, coalesce((trend > 0 AND high - greatest(open, close) >= 2.0 * abs(close - open) AND high > low) OR (trend < 0 AND least(open, close) - low >= 2.0 * abs(close - open) AND high > low), false) AS exhausted FROM c""")
def _(spark, d):
    frame = hourly(spark, d).withColumn("trend", F.signum(F.lag("close", 1).over(V.in_time()) - F.lag("close", 4).over(V.in_time())))
    moved = F.col("high") > F.col("low")
    out = ((F.col("trend") > 0) & (S.upper_wick() >= 2.0 * S.body()) & moved) | ((F.col("trend") < 0) & (S.lower_wick() >= 2.0 * S.body()) & moved)
    return frame.select("symbol", secs(), F.coalesce(out, F.lit(False)).alias("exhausted"))


@query("f16_fib_zones", f"""{POS}, l AS (SELECT *, min(low) OVER w AS a, max(high) OVER w AS b FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT {KEY}, round(b - (b - a) * 0.5, 6) AS f50, round(b - (b - a) * 0.618, 6) AS f618, round(b + (b - a) * 0.272, 6) AS ext127,
  close >= b - (b - a) * 0.618 AND close <= b - (b - a) * 0.5 AS golden, close >= b - (b - a) * 0.5 AND close <= b - (b - a) * 0.382 AS shallow, close < b - (b - a) * 0.786 AS invalid FROM l WHERE a IS NOT NULL""")
def _(spark, d):
    frame = V.rows(-24, -1)
    legs = hourly(spark, d).withColumn("a", F.min("low").over(frame)).withColumn("b", F.max("high").over(frame)).where("a is not null")
    a, b, close = F.col("a"), F.col("b"), F.col("close")
    level = lambda r: S.fib_level(a, b, r)
    return legs.select(
        "symbol", secs(), r6(level(0.5), "f50"), r6(level(0.618), "f618"), r6(b + (b - a) * 0.272, "ext127"),
        S.between_levels(close, level(0.618), level(0.5)).alias("golden"), S.between_levels(close, level(0.5), level(0.382)).alias("shallow"), (close < level(0.786)).alias("invalid"),
    )


@query("w01_ema_20", f"""{POS}
SELECT {KEY}, CASE WHEN pos >= 19 THEN round(list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, b: a + 2.0 / 21 * (b - a)), 6) END AS ema FROM x""")
def _(spark, d):
    return V.smoothed(placed(spark, d), {"ema": V.ema_spec("close", 20)}).select("symbol", secs(), r6("ema", "ema"))


@query("w02_atr_14", f"{ATR} SELECT {KEY}, round(atr, 6) AS atr FROM z")
def _(spark, d):
    return with_atr(spark, d).select("symbol", secs(), r6("atr", "atr"))


@query("w03_wilder_atr", f"""{POS}, y AS (SELECT *, lag(close) OVER (PARTITION BY symbol, et::DATE ORDER BY ts) AS dc FROM x),
t AS (SELECT *, greatest(high - low, abs(high - dc), abs(low - dc)) AS tr FROM y)
SELECT {KEY}, CASE WHEN pos >= 13 THEN round(list_reduce(list(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, b: a + 1.0 / 14 * (b - a)), 6) END AS atr FROM t""")
def _(spark, d):
    frame = placed(spark, d).withColumn("dc", F.lag("close").over(V.day_window()))
    frame = frame.withColumn("tr", V.true_range(F.col("dc")))
    return V.smoothed(frame, {"atr": V.wilder_spec("tr", 14)}).select("symbol", secs(), r6("atr", "atr"))


@query("w04_session_vwap", f"""{POS}
SELECT {KEY}, round(sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0), 6) AS vwap FROM x WINDOW d AS (PARTITION BY symbol, et::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return hourly(spark, d).select("symbol", secs(), r6(V.session_vwap(), "vwap"))


_SWING = f"""{POS}, f AS (
  SELECT *, CASE WHEN count(*) OVER k = 5 THEN high = max(high) OVER k END AS sh, CASE WHEN count(*) OVER k = 5 THEN low = min(low) OVER k END AS sl
  FROM x WINDOW k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
), g AS (
  SELECT *, lag(CASE WHEN sh THEN high END, 2) OVER w AS rh, lag(CASE WHEN sl THEN low END, 2) OVER w AS rl FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)
), s AS (
  SELECT *, last_value(rh IGNORE NULLS) OVER u AS ch, last_value(rl IGNORE NULLS) OVER u AS cl FROM g WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)
)"""


def swings(spark, d):
    frame = placed(spark, d).withColumn("sh", V.centered_swing("high", True, 2)).withColumn("sl", V.centered_swing("low", False, 2))
    return frame.withColumn("ch", V.confirmed(F.col("sh"), "high", 2)).withColumn("cl", V.confirmed(F.col("sl"), "low", 2))


@query("w06_centered_swings", f"{_SWING} SELECT {KEY}, sh AS swing_high, sl AS swing_low FROM s")
def _(spark, d):
    return swings(spark, d).select("symbol", secs(), F.col("sh").alias("swing_high"), F.col("sl").alias("swing_low"))


@query("w07_confirmed_swings", f"{_SWING} SELECT {KEY}, ch AS swing_high, cl AS swing_low FROM s")
def _(spark, d):
    return swings(spark, d).select("symbol", secs(), F.col("ch").alias("swing_high"), F.col("cl").alias("swing_low"))


@query("w08_last_two_pivots", f"""{_SWING}, p AS (SELECT *, list(CASE WHEN sh THEN high END) FILTER (WHERE sh) OVER c AS hs FROM s WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))
SELECT {KEY}, hs[-1] AS last_high, hs[-2] AS previous_high FROM p""")
def _(spark, d):
    frame = swings(spark, d).withColumn("p", V.last_pivots("sh", "high", 2, 2))
    return frame.select("symbol", secs(), F.col("p")[1]["high"].alias("last_high"), F.col("p")[0]["high"].alias("previous_high"))


@query("w11_fractals", f"""{POS}
SELECT {KEY}, count(*) OVER a = 2 AND count(*) OVER b = 2 AND high > max(high) OVER b AND high >= max(high) OVER a AS top, count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER b AND low <= min(low) OVER a AS bottom
FROM x WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""")
def _(spark, d):
    return hourly(spark, d).select("symbol", secs(), V.fractal("high", True, 2).alias("top"), V.fractal("low", False, 2).alias("bottom"))


@query("w12_rolling_percentile", f"""{POS}, p AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS l FROM x)
SELECT {KEY}, CASE WHEN len(l) = 100 THEN round((len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0) / 100, 6) END AS pctile FROM p""")
def _(spark, d):
    return hourly(spark, d).select("symbol", secs(), r6(V.percent_rank_within("close", 100), "pctile"))


@query("w14_run_length", f"""{POS}, c AS (SELECT *, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS s FROM x),
m AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS ch FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT {KEY}, s AS state, row_number() OVER (PARTITION BY symbol, isl ORDER BY ts) AS run FROM i""")
def _(spark, d):
    frame = hourly(spark, d).withColumn("state", F.signum(F.col("close") - F.col("open")).cast("int"))
    return V.run_length(frame, "state").select("symbol", secs(), "state", F.col("run").cast("long").alias("run"))


@query("w15_bars_since_sweep", f"""{_SWING}, q AS (SELECT *, (high > ch AND close < ch) OR (low < cl AND close > cl) AS swept FROM s)
SELECT {KEY}, pos - coalesce(max(CASE WHEN swept THEN pos END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), -1) AS since FROM q""")
def _(spark, d):
    swept = ((F.col("high") > F.col("ch")) & (F.col("close") < F.col("ch"))) | ((F.col("low") < F.col("cl")) & (F.col("close") > F.col("cl")))
    return swings(spark, d).select("symbol", secs(), V.rows_since(swept).cast("long").alias("since"))


@query("w16_forward_return_bins", f"""{ATR}, f AS (SELECT *, (lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - close) / CASE WHEN atr > 0 THEN atr END AS fr FROM z)
SELECT {KEY}, round(fr, 6) AS forward, CASE WHEN fr IS NOT NULL THEN (fr >= -1.5)::INT + (fr >= -0.5)::INT + (fr >= 0.5)::INT + (fr >= 1.5)::INT END AS bin FROM f""")
def _(spark, d):
    frame = with_atr(spark, d).withColumn("f", V.forward_return(5))
    return frame.select("symbol", secs(), r6("f", "forward"), S.bucket(F.col("f"), [-1.5, -0.5, 0.5, 1.5]).alias("bin"))


@query("w17_session_variance_sums", f"""{POS}, r AS (SELECT *, pow(ln(close) - ln(lag(close) OVER (PARTITION BY symbol, et::DATE ORDER BY ts)), 2) AS sq FROM x)
SELECT {KEY}, CASE WHEN count(sq) OVER t = 6 THEN round(sum(sq) OVER t, 6) END AS trailing, CASE WHEN count(sq) OVER f = 6 THEN round(sum(sq) OVER f, 6) END AS forward, round(sum(sq) OVER c, 6) AS so_far, max(high) OVER f AS forward_high, min(low) OVER f AS forward_low
FROM r WINDOW t AS (PARTITION BY symbol, et::DATE ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), f AS (PARTITION BY symbol, et::DATE ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), c AS (PARTITION BY symbol, et::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    day = V.day_window()
    frame = hourly(spark, d).withColumn("sq", F.pow(V.log_return(day), 2))
    sq, ahead = F.col("sq"), V.rows(1, 6, day)
    return frame.select(
        "symbol", secs(), r6(V.trailing_sum(sq, 6, day), "trailing"), r6(V.forward_sum(sq, 6, day), "forward"), r6(F.sum(sq).over(V.rows(V.UNBOUNDED, 0, day)), "so_far"),
        F.max("high").over(ahead).alias("forward_high"), F.min("low").over(ahead).alias("forward_low"),
    )


@query("w21_opening_range", f"""{POS}, o AS (SELECT *, hour(et) = 9 OR hour(et) = 10 AS opening FROM x)
SELECT {KEY}, max(CASE WHEN opening THEN high END) OVER d AS or_high, min(CASE WHEN opening THEN low END) OVER d AS or_low FROM o WINDOW d AS (PARTITION BY symbol, et::DATE)""")
def _(spark, d):
    local = T.eastern(F.col("ts"))
    day = Window.partitionBy("symbol", F.to_date(local))
    opening = F.hour(local).isin(9, 10)
    return hourly(spark, d).select("symbol", secs(), F.max(F.when(opening, F.col("high"))).over(day).alias("or_high"), F.min(F.when(opening, F.col("low"))).over(day).alias("or_low"))


@query("w23_median_day_range", f"""{POS}, g AS (SELECT symbol, et::DATE AS day, avg(high - low) AS m FROM x GROUP BY symbol, et::DATE)
SELECT symbol, day::VARCHAR AS day, CASE WHEN count(m) OVER w = 5 THEN round(quantile_cont(m, 0.5) OVER w, 6) END AS median FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    daily = hourly(spark, d).groupBy("symbol", F.to_date(T.eastern(F.col("ts"))).alias("day")).agg(F.avg(F.col("high") - F.col("low")).alias("m"))
    frame = Window.partitionBy("symbol").orderBy("day").rowsBetween(-5, -1)
    median = F.when(F.count("m").over(frame) == 5, F.percentile("m", F.lit(0.5)).over(frame))
    return daily.select("symbol", F.col("day").cast("string").alias("day"), r6(median, "median"))


@query("w24_participation", f"""{POS} SELECT {KEY}, CASE WHEN count(*) OVER w = 10 THEN round(volume / quantile_cont(volume, 0.5) OVER w, 6) END AS participation FROM x WINDOW w AS (PARTITION BY symbol, hour(et) ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    slot = Window.partitionBy("symbol", F.hour(T.eastern(F.col("ts")))).orderBy("ts").rowsBetween(-10, -1)
    value = F.when(F.count(F.lit(1)).over(slot) == 10, F.col("volume") / F.percentile("volume", F.lit(0.5)).over(slot))
    return hourly(spark, d).select("symbol", secs(), r6(value, "participation"))


@query("w26_efficiency_ratio", f"""{POS}, s AS (SELECT *, abs(close - pc) AS step, abs(close - lag(close, 12) OVER (PARTITION BY symbol ORDER BY ts)) AS net FROM x)
SELECT {KEY}, CASE WHEN count(step) OVER w = 12 AND sum(step) OVER w > 0 THEN round(net / sum(step) OVER w, 6) END AS er FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    frame = hourly(spark, d).withColumn("step", F.abs(F.col("close") - F.lag("close").over(V.in_time())))
    return frame.select("symbol", secs(), r6(V.efficiency_ratio(12), "er"))


@query("w35_jumps", f"""{POS}, m AS (SELECT symbol, quantile_cont(abs(close - pc), 0.5) AS med FROM x GROUP BY symbol)
SELECT {KEY.replace('symbol', 'x.symbol')}, round(abs(close - pc), 6) AS move FROM x JOIN m USING (symbol) WHERE abs(close - pc) > 5 * med""")
def _(spark, d):
    frame = hourly(spark, d).withColumn("move", F.abs(F.col("close") - F.lag("close").over(V.in_time())))
    usual = frame.groupBy("symbol").agg(F.percentile("move", F.lit(0.5)).alias("usual"))
    return frame.join(usual, "symbol").where("move > 5 * usual").select("symbol", secs(), r6("move", "move"))


@query("w36_largest_gap", f"""{BARS}, g AS (SELECT symbol, epoch(ts)::BIGINT AS ts, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM bars)
SELECT symbol, max(gap) AS gap, min(ts) FILTER (WHERE gap = mx) AS ts FROM (SELECT *, max(gap) OVER (PARTITION BY symbol) AS mx FROM g) GROUP BY symbol""")
def _(spark, d):
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    frame = hourly(spark, d).select("symbol", t.alias("ts")).withColumn("gap", F.col("ts") - F.lag("ts").over(V.in_time())).where("gap is not null")
    return frame.groupBy("symbol").agg(F.max("gap").alias("gap"), (-F.max_by(-F.col("ts"), F.struct(F.col("gap"), -F.col("ts")))).alias("ts"))


_DAYS = "d AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS end_ts, last(close ORDER BY bars.ts) AS day_close, max(high) AS day_high FROM bars GROUP BY symbol, date_trunc('day', ts))"


def daily(spark, d):
    days = B.resample(hourly(spark, d), 1440)
    return days.select("symbol", (F.col("ts") + F.expr("INTERVAL '1' DAY")).alias("end_ts"), F.col("close").alias("day_close"), F.col("high").alias("day_high"))


@query("j01_asof_backward", f"""{BARS}, {_DAYS} SELECT b.symbol, epoch(b.ts)::BIGINT AS ts, close, day_close, day_high FROM bars b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.ts >= d.end_ts""")
def _(spark, d):
    return J.as_of(hourly(spark, d), daily(spark, d), ["symbol"], "ts", "end_ts", ["day_close", "day_high"]).select("symbol", secs(), "close", "day_close", "day_high")


@query("j04_asof_forward", f"""{BARS}, {_DAYS} SELECT d.symbol, epoch(d.end_ts)::BIGINT AS ts, b.open AS next_open, epoch(b.ts)::BIGINT AS next_ts FROM d ASOF LEFT JOIN bars b ON d.symbol = b.symbol AND d.end_ts <= b.ts""")
def _(spark, d):
    bars = hourly(spark, d).select("symbol", "ts", F.col("open").alias("next_open"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("next_ts"))
    return J.as_of(daily(spark, d), bars, ["symbol"], "end_ts", "ts", ["next_open", "next_ts"], forward=True).select("symbol", secs("end_ts"), "next_open", "next_ts")


@query("j06_range_join_excursion", f"""{POS}, t AS (SELECT symbol, ts AS entry, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS exit, close AS price, pos FROM x)
SELECT t.symbol, epoch(t.entry)::BIGINT AS ts, round(max(b.high) - any_value(t.price), 6) AS mfe, round(any_value(t.price) - min(b.low), 6) AS mae, count(*) AS n
FROM t JOIN bars b ON t.symbol = b.symbol AND b.ts BETWEEN t.entry AND t.exit GROUP BY t.symbol, t.entry""")
def _(spark, d):
    trades = placed(spark, d).select("symbol", F.col("ts").alias("entry"), F.lead("ts", 5).over(V.in_time()).alias("exit"), F.col("close").alias("price"), "pos").where("exit is not null").drop("pos")
    met = J.in_range(trades, hourly(spark, d), ["symbol"], "entry", "exit", "ts", 6 * 3600)
    out = met.groupBy("symbol", "entry").agg(r6(F.max("high") - F.first("price"), "mfe"), r6(F.first("price") - F.min("low"), "mae"), F.count("*").alias("n"))
    return out.select("symbol", secs("entry"), "mfe", "mae", "n")


@query("j08_prior_day_close", f"""{POS}, g AS (SELECT symbol, et::DATE AS day, last(close ORDER BY ts) FILTER (WHERE hour(et) < 16) AS dc FROM x GROUP BY symbol, et::DATE)
SELECT {KEY.replace('symbol', 'x.symbol')}, g.dc AS prior_close FROM x LEFT JOIN g ON g.symbol = x.symbol AND g.day + 1 = x.et::DATE""")
def _(spark, d):
    bars = hourly(spark, d).withColumn("et", T.eastern(F.col("ts"))).withColumn("day", F.to_date("et"))
    prior = bars.where(F.hour("et") < 16).groupBy("symbol", F.date_add("day", 1).alias("day")).agg(F.max_by("close", "ts").alias("prior_close"))
    return bars.join(prior, ["symbol", "day"], "left").select("symbol", secs(), "prior_close")


@query("j11_outer_daily_difference", f"""{TICKS.join(['WITH ', ''])}, s AS (SELECT ts::DATE AS day, symbol, sum(price) AS v FROM ticks GROUP BY ALL),
a AS (SELECT day, v FROM s WHERE symbol = 'click'), b AS (SELECT day, v FROM s WHERE symbol = 'error')
SELECT coalesce(a.day, b.day)::VARCHAR AS day, round(coalesce(a.v, 0) - coalesce(b.v, 0), 6) AS diff FROM a FULL JOIN b ON a.day = b.day""")
def _(spark, d):
    sums = ticks(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("price").alias("v"))
    a, b = (sums.where(F.col("symbol") == s).select("day", F.col("v").alias(n)) for s, n in (("click", "a"), ("error", "b")))
    return a.join(b, "day", "full_outer").select(F.col("day").cast("string").alias("day"), r6(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), "diff"))


@query("j13_feed_difference", f"""{BARS}, a AS (SELECT ts FROM bars WHERE symbol = 'click'), b AS (SELECT ts FROM bars WHERE symbol = 'view')
SELECT epoch(coalesce(a.ts, b.ts))::BIGINT AS ts, CASE WHEN b.ts IS NULL THEN 'only_a' WHEN a.ts IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.ts = b.ts""")
def _(spark, d):
    bars = hourly(spark, d)
    return J.difference(bars.where("symbol = 'click'"), bars.where("symbol = 'view'"), ["ts"]).select(secs(), "side")


@query("j17_nearest_level", f"""{POS}, h AS (SELECT symbol, et::DATE AS day, max(high) AS level FROM x GROUP BY ALL)
SELECT {KEY.replace('symbol', 'x.symbol')}, min(h.level) FILTER (WHERE h.level > x.close) AS above, max(h.level) FILTER (WHERE h.level < x.close) AS below
FROM x LEFT JOIN h ON h.symbol = x.symbol AND h.day < x.et::DATE AND h.day >= x.et::DATE - 5 GROUP BY x.symbol, x.ts""")
def _(spark, d):
    bars = hourly(spark, d).withColumn("day", F.to_date(T.eastern(F.col("ts"))))
    levels = bars.groupBy("symbol", "day").agg(F.max("high").alias("level")).withColumn("day", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 5))))
    met = bars.join(levels, ["symbol", "day"], "left")
    out = met.groupBy("symbol", "ts").agg(F.min(F.when(F.col("level") > F.col("close"), F.col("level"))).alias("above"), F.max(F.when(F.col("level") < F.col("close"), F.col("level"))).alias("below"))
    return out.select("symbol", secs(), "above", "below")


@query("j21_anti_join", f"""{BARS} SELECT {KEY} FROM bars b WHERE symbol = 'click' AND NOT EXISTS (SELECT 1 FROM bars o WHERE o.symbol = 'purchase' AND o.ts = b.ts)""")
def _(spark, d):
    bars = hourly(spark, d)
    return bars.where("symbol = 'click'").join(bars.where("symbol = 'purchase'").select("ts"), "ts", "left_anti").select("symbol", secs())


@query("u01_set_operations", f"""{BARS}, a AS (SELECT ts FROM bars WHERE symbol = 'click'), b AS (SELECT ts FROM bars WHERE symbol = 'view')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'subtract', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(spark, d):
    bars = hourly(spark, d)
    a, b = (bars.where(F.col("symbol") == s).select("ts") for s in ("click", "view"))
    count = lambda name, frame: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return count("union", a.union(b).distinct()).unionByName(count("intersect", a.intersect(b))).unionByName(count("subtract", a.subtract(b)))


@query("g15_quarter_bars", f"{QUARTERS} SELECT {KEY}, open, high, low, close, volume FROM bars")
def _(spark, d):
    return B.bars_of_ticks(ticks(spark, d), 15).select("symbol", secs(), *tables.BAR_COLUMNS)
