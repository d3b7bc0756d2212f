"""Joins between timeframes, feeds, levels and snapshots, and the sets they leave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import daily, hourly, placed, r6, secs, ticks
from barspark.catalog.sql import BARS, POS, QUARTERS, TICKS, _bars
from barspark.functions import session as T
from barspark.operators import bars as B
from barspark.operators import joins as J
from barspark.operators import windows as V
from barspark.operators.windows import in_time

_COARSE = """h1 AS (SELECT symbol, ts + INTERVAL 1 HOUR AS end_ts, close AS c1 FROM bars), h4 AS (SELECT symbol, to_timestamp(floor(epoch(ts) / 14400)::BIGINT * 14400 + 14400) AT TIME ZONE 'UTC' AS end_ts, last(close ORDER BY bars.ts) AS c4 FROM bars GROUP BY symbol, floor(epoch(ts) / 14400))"""
_FINE = f"WITH RECURSIVE {TICKS}, {_bars(15).replace('bars AS', 'fine AS', 1)}, {_bars(60)}"


def fine(spark, d):
    return B.bars_of_ticks(ticks(spark, d), 15)


@query("j03_snapshots", f"""{_FINE}, {_COARSE}, d1 AS (SELECT symbol, ts + INTERVAL 15 MINUTE AS now, close FROM fine)
SELECT d1.symbol, epoch(now)::BIGINT AS ts, close, c1, c4 FROM d1 ASOF LEFT JOIN h1 ON h1.symbol = d1.symbol AND now >= h1.end_ts ASOF LEFT JOIN h4 ON h4.symbol = d1.symbol AND now >= h4.end_ts""")
def _(spark, d):
    hours = hourly(spark, d)
    one = hours.select("symbol", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("end_ts"), F.col("close").alias("c1"))
    four = B.resample(hours, 240).select("symbol", (F.col("ts") + F.expr("INTERVAL '4' HOUR")).alias("end_ts"), F.col("close").alias("c4"))
    driving = fine(spark, d).select("symbol", (F.col("ts") + F.expr("INTERVAL '15' MINUTE")).alias("now"), "close")
    out = J.as_of(J.as_of(driving, one, ["symbol"], "now", "end_ts", ["c1"]), four, ["symbol"], "now", "end_ts", ["c4"])
    return out.select("symbol", secs("now"), "close", "c1", "c4")


@query("j05_bars_up_to_cursor", f"""{_FINE}, cu AS (SELECT symbol, ts + INTERVAL 1 HOUR AS now FROM bars), fc AS (SELECT symbol, ts + INTERVAL 15 MINUTE AS done, close FROM fine)
SELECT cu.symbol, epoch(now)::BIGINT AS ts, count(*) AS n, round(avg(close), 6) AS mean FROM cu JOIN fc ON fc.symbol = cu.symbol AND done <= now AND done > now - INTERVAL 4 HOUR GROUP BY cu.symbol, now""")
def _(spark, d):
    cursors = hourly(spark, d).select("symbol", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("now")).withColumn("from_", F.col("now") - F.expr("INTERVAL '4' HOUR"))
    done = fine(spark, d).select("symbol", (F.col("ts") + F.expr("INTERVAL '15' MINUTE")).alias("done"), "close")
    met = J.in_range(cursors, done, ["symbol"], "from_", "now", "done", 4 * 3600, F.col("done") > F.col("from_"))
    return met.groupBy("symbol", "now").agg(F.count("*").alias("n"), r6(F.avg("close"), "mean")).select("symbol", secs("now"), "n", "mean")


@query("j09_prior_session", f"""{POS}, g AS (SELECT symbol, et::DATE AS day, max(high) AS h, sum(volume) AS v FROM x GROUP BY ALL), l AS (SELECT symbol, day, lag(h) OVER w AS prior_high, lag(v) OVER w AS prior_volume FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT x.symbol, epoch(x.ts)::BIGINT AS ts, prior_high, prior_volume FROM x JOIN l ON l.symbol = x.symbol AND l.day = x.et::DATE""")
def _(spark, d):
    bars = hourly(spark, d).withColumn("day", F.to_date(T.eastern(F.col("ts"))))
    by_day = bars.groupBy("symbol", "day").agg(F.max("high").alias("h"), F.sum("volume").alias("v"))
    line = Window.partitionBy("symbol").orderBy("day")
    prior = by_day.select("symbol", "day", F.lag("h").over(line).alias("prior_high"), F.lag("v").over(line).alias("prior_volume"))
    return bars.join(prior, ["symbol", "day"]).select("symbol", secs(), "prior_high", "prior_volume")


@query("j10_reindexed_features", f"""{_FINE} SELECT f.symbol, epoch(f.ts)::BIGINT AS ts, b.close AS hour_close, b.volume AS hour_volume FROM fine f LEFT JOIN bars b ON b.symbol = f.symbol AND b.ts = f.ts""")
def _(spark, d):
    hours = hourly(spark, d).select("symbol", "ts", F.col("close").alias("hour_close"), F.col("volume").alias("hour_volume"))
    return fine(spark, d).join(hours, ["symbol", "ts"], "left").select("symbol", secs(), "hour_close", "hour_volume")


@query("j14_session_forward_fill", f"""{_FINE}, m AS (SELECT f.symbol, f.ts, ((f.ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS day, f.close, ln(b.high) - ln(b.low) AS v FROM fine f LEFT JOIN bars b ON b.symbol = f.symbol AND b.ts = f.ts AND b.low > 0)
SELECT symbol, epoch(ts)::BIGINT AS ts, round(close * last_value(v IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS distance FROM m""")
def _(spark, d):
    hours = hourly(spark, d).where("low > 0").select("symbol", "ts", (F.ln("high") - F.ln("low")).alias("v"))
    rows = fine(spark, d).join(hours, ["symbol", "ts"], "left")
    carried = F.last("v", ignorenulls=True).over(V.rows(V.UNBOUNDED, 0, V.day_window()))
    return rows.select("symbol", secs(), r6(F.col("close") * carried, "distance"))


@query("j19_nearest_within_tolerance", f"""{BARS}, dy AS (SELECT symbol, date_trunc('day', ts) AS day, max(high) AS level FROM bars GROUP BY ALL), hu AS (SELECT symbol, ts, close FROM bars),
n AS (SELECT hu.symbol, hu.ts, hu.close, (SELECT max(level) FROM dy WHERE dy.symbol = hu.symbol AND level <= hu.close) AS below, (SELECT min(level) FROM dy WHERE dy.symbol = hu.symbol AND level >= hu.close) AS above FROM hu),
p AS (SELECT *, CASE WHEN below IS NULL OR above - close < close - below THEN above ELSE below END AS level FROM n)
SELECT symbol, epoch(ts)::BIGINT AS ts, level FROM p WHERE abs(level - close) <= 0.05 * abs(close)""")
def _(spark, d):
    bars = hourly(spark, d)
    levels = bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.max("high").alias("level")).select("symbol", "level").distinct()
    return J.nearest_level(bars.select("symbol", "ts", "close"), levels, ["symbol"], "close", "level", 0.05).select("symbol", secs(), "level")


@query("j20_matched_swings", f"""{_FINE}, ha AS (SELECT symbol, ts, high FROM bars), fb AS (SELECT symbol, to_timestamp(floor(epoch(ts) / 3600)::BIGINT * 3600) AT TIME ZONE 'UTC' AS hour, ts, high FROM fine),
c AS (SELECT ha.symbol, ha.ts AS a, fb.ts AS b, abs(ha.high - fb.high) AS off, row_number() OVER (PARTITION BY ha.symbol, ha.ts ORDER BY abs(ha.high - fb.high), fb.ts) AS rn FROM ha JOIN fb ON fb.symbol = ha.symbol AND fb.hour BETWEEN ha.ts - INTERVAL 1 HOUR AND ha.ts + INTERVAL 1 HOUR AND abs(ha.high - fb.high) <= 0.001 * abs(ha.high)),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, b ORDER BY off, a) AS taken FROM c WHERE rn = 1) SELECT symbol, epoch(a)::BIGINT AS ts, epoch(b)::BIGINT AS matched, round(off, 6) AS off FROM k WHERE taken = 1""")
def _(spark, d):
    a = hourly(spark, d).select("symbol", F.col("ts").alias("a"), F.col("high").alias("ha"))
    b = fine(spark, d).select("symbol", F.col("ts").alias("b"), F.col("high").alias("hb"), B.floor_utc("ts", 60).alias("hour"))
    near = a.withColumn("hour", F.explode(F.expr("sequence(a - INTERVAL '1' HOUR, a + INTERVAL '1' HOUR, INTERVAL '1' HOUR)")))
    met = near.join(b, ["symbol", "hour"]).withColumn("off", F.abs(F.col("ha") - F.col("hb"))).where("off <= 0.001 * abs(ha)")
    met = met.withColumn("rn", F.row_number().over(Window.partitionBy("symbol", "a").orderBy("off", "b"))).where("rn = 1")
    met = met.withColumn("taken", F.row_number().over(Window.partitionBy("symbol", "b").orderBy("off", "a"))).where("taken = 1")
    return met.select("symbol", secs("a"), F.unix_seconds(F.col("b").cast("timestamp")).alias("matched"), r6("off", "off"))


@query("j22_positional_zip", f"""{POS}, a AS (SELECT row_number() OVER (ORDER BY ts) AS i, close - open AS ra FROM x WHERE symbol = 'click'), b AS (SELECT row_number() OVER (ORDER BY ts) AS i, close - open AS rb FROM x WHERE symbol = 'view') SELECT count(*) AS n, round(avg(ra - rb), 6) AS mean, round(corr(ra, rb), 6) AS correlation FROM a JOIN b USING (i)""")
def _(spark, d):
    arm = lambda s, n: placed(spark, d).where(F.col("symbol") == s).select(F.col("pos").alias("i"), (F.col("close") - F.col("open")).alias(n))
    return arm("click", "ra").join(arm("view", "rb"), "i").agg(F.count("*").alias("n"), r6(F.avg(F.col("ra") - F.col("rb")), "mean"), r6(F.corr("ra", "rb"), "correlation"))


_CONTRACT = "CASE WHEN floor(epoch(ts) / 864000) % 2 = 0 THEN 'A' ELSE 'B' END"


@query("j23_contract_mismatch", f"""{BARS}, q AS (SELECT symbol, ts AS qts, price, {_CONTRACT} AS qc FROM ticks), qq AS (SELECT symbol, qts, arg_max(price, seq) AS price, any_value(qc) AS qc FROM (SELECT q.*, t.seq FROM q JOIN ticks t ON t.symbol = q.symbol AND t.ts = q.qts AND t.price = q.price) GROUP BY symbol, qts),
b AS (SELECT symbol, ts + INTERVAL 1 HOUR AS done, close, CASE WHEN floor(epoch(ts) / 864000) % 2 = 0 THEN 'A' ELSE 'B' END AS bc FROM bars)
SELECT b.symbol, epoch(done)::BIGINT AS ts, bc, qc, coalesce(bc = qc, false) AS valid FROM b ASOF LEFT JOIN qq ON qq.symbol = b.symbol AND b.done >= qq.qts""")
def _(spark, d):
    contract = lambda c: F.when(F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 864000) % 2 == 0, "A").otherwise("B")
    quotes = ticks(spark, d).groupBy("symbol", F.col("ts").alias("qts")).agg(F.max_by("price", "seq").alias("price")).withColumn("qc", contract("qts"))
    bars = hourly(spark, d).select("symbol", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("done"), contract("ts").alias("bc"))
    out = J.as_of(bars, quotes, ["symbol"], "done", "qts", ["qc"])
    return out.select("symbol", secs("done"), "bc", "qc", F.coalesce(F.col("bc") == F.col("qc"), F.lit(False)).alias("valid"))


@query("j24_snapshot_difference", f"""{BARS}, o AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n, max(high) AS h FROM bars WHERE ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL), w AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n, max(high) AS h FROM bars WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL)
SELECT coalesce(o.symbol, w.symbol) AS symbol, epoch(coalesce(o.day, w.day))::BIGINT AS ts, CASE WHEN w.symbol IS NULL THEN 'removed' WHEN o.symbol IS NULL THEN 'added' WHEN o.n = w.n AND o.h = w.h THEN 'same' ELSE 'changed' END AS state, CASE WHEN o.symbol IS NOT NULL AND w.symbol IS NOT NULL THEN concat_ws(',', CASE WHEN o.n <> w.n THEN 'n' END, CASE WHEN o.h <> w.h THEN 'h' END) ELSE '' END AS fields FROM o FULL JOIN w ON o.symbol = w.symbol AND o.day = w.day""")
def _(spark, d):
    days = lambda frame: frame.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"), F.max("high").alias("h"))
    bars = hourly(spark, d)
    out = J.snapshot_difference(days(bars.where("ts < timestamp_ntz'2024-01-20 12:00:00'")), days(bars.where("ts >= timestamp_ntz'2024-01-10 00:00:00'")), ["symbol", "ts"], ["n", "h"])
    return out.select("symbol", secs(), "state", "fields")


@query("u05_union_of_folds", f"""{POS} SELECT fold, count(*) AS n, round(avg(close), 6) AS mean FROM (SELECT 0 AS fold, close FROM x WHERE pos < 50 UNION ALL SELECT 1, close FROM x WHERE pos >= 50 AND pos < 100 UNION ALL SELECT 2, close FROM x WHERE pos >= 100) GROUP BY fold""")
def _(spark, d):
    bars = placed(spark, d)
    parts = [bars.where(c).select(F.lit(i).alias("fold"), "close") for i, c in enumerate(("pos < 50", "pos >= 50 and pos < 100", "pos >= 100"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg("close"), "mean"))


_ARMS = [("hour", "close - open"), ("day", "close - lag(close, 24) OVER w"), ("range", "high - low")]


@query("u06_concatenated_arms", f"""{POS}, arms AS ({" UNION ALL ".join(f"SELECT '{n}' AS arm, symbol, pos, ts, {e} AS gain FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)" for n, e in _ARMS)}),
zipped AS (SELECT *, row_number() OVER (PARTITION BY arm, symbol ORDER BY ts) AS i FROM arms WHERE gain IS NOT NULL), base AS (SELECT symbol, i, gain AS b FROM zipped WHERE arm = 'hour')
SELECT arm, symbol, count(*) AS n, round(avg(gain - b), 6) AS mean, round(sum(gain - b), 6) AS total FROM zipped JOIN base USING (symbol, i) WHERE arm <> 'hour' GROUP BY arm, symbol""")
def _(spark, d):
    """Arms stacked under their names, each row against the base arm's row of the same place, up to the shorter one's end."""
    bars = placed(spark, d)
    gains = {"hour": F.col("close") - F.col("open"), "day": F.col("close") - F.lag("close", 24).over(in_time()), "range": F.col("high") - F.col("low")}
    stacked = None
    for name, gain in gains.items():
        arm = bars.select(F.lit(name).alias("arm"), "symbol", "ts", gain.alias("gain"))
        stacked = arm if stacked is None else stacked.unionByName(arm)
    zipped = stacked.where("gain is not null").withColumn("i", F.row_number().over(Window.partitionBy("arm", "symbol").orderBy("ts")))
    base = zipped.where("arm = 'hour'").select("symbol", "i", F.col("gain").alias("b"))
    met = zipped.where("arm <> 'hour'").join(base, ["symbol", "i"])
    return met.groupBy("arm", "symbol").agg(F.count("*").alias("n"), r6(F.avg(F.col("gain") - F.col("b")), "mean"), r6(F.sum(F.col("gain") - F.col("b")), "total"))


@query("u07_gaps_of_both_timeframes", f"""{_FINE}, g AS (SELECT 'fine' AS timeframe, symbol, ts, high, low, lag(high, 2) OVER w AS h0, lag(low, 2) OVER w AS l0 FROM fine WINDOW w AS (PARTITION BY symbol ORDER BY ts) UNION ALL SELECT 'hour', symbol, ts, high, low, lag(high, 2) OVER w, lag(low, 2) OVER w FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT timeframe, symbol, count(*) AS n, count(*) FILTER (WHERE low > h0) AS up FROM g WHERE low > h0 OR high < l0 GROUP BY ALL""")
def _(spark, d):
    line = V.in_time
    gaps = lambda bars, name: bars.select(F.lit(name).alias("timeframe"), "symbol", "high", "low", F.lag("high", 2).over(line()).alias("h0"), F.lag("low", 2).over(line()).alias("l0"))
    both = gaps(fine(spark, d), "fine").unionByName(gaps(hourly(spark, d), "hour")).where("low > h0 or high < l0")
    return both.groupBy("timeframe", "symbol").agg(F.count("*").alias("n"), F.count_if(F.col("low") > F.col("h0")).alias("up"))


@query("s01_range_and_latest", f"""{QUARTERS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00') SELECT symbol, epoch(ts)::BIGINT AS ts, close FROM l WHERE rn <= 8""")
def _(spark, d):
    bars = fine(spark, d).where("ts >= timestamp_ntz'2024-01-05 00:00:00' and ts < timestamp_ntz'2024-01-25 00:00:00'")
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))).where("rn <= 8").select("symbol", secs(), "close")


@query("s15_delta_periods", f"""{BARS}, g AS (SELECT symbol, max(epoch(ts)) AS last FROM bars GROUP BY symbol) SELECT symbol, least(7, greatest(1, ceil((1707000000 - last) / 86400.0)))::BIGINT AS days FROM g""")
def _(spark, d):
    last = hourly(spark, d).groupBy("symbol").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("last"))
    return last.select("symbol", F.least(F.lit(7), F.greatest(F.lit(1), F.ceil((1707000000 - F.col("last")) / 86400))).cast("long").alias("days"))


@query("j02_daily_ends", f"{BARS} SELECT symbol, epoch(date_trunc('day', ts) + INTERVAL 1 DAY)::BIGINT AS ts, last(close ORDER BY bars.ts) AS day_close FROM bars GROUP BY symbol, date_trunc('day', ts)")
def _(spark, d):
    return daily(spark, d).select("symbol", secs("end_ts"), "day_close")
