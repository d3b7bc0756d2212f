"""Signals, exits and risk rules over hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import hourly, placed, r6, secs, with_atr
from barspark.catalog.signals import _ENTRIES, entries
from barspark.catalog.sql import ATR, POS
from barspark.functions import scalars as S
from barspark.functions import session as T
from barspark.operators import firsthit as H
from barspark.operators import windows as V
from barspark.plans import simulation as P
from barspark.plans import strategies as G

_LIST = "list({0}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _ema(column: str, span: int) -> str:
    return f"list_reduce({_LIST.format(column)}, lambda a, b: a + 2.0 / {span + 1} * (b - a))"


@query("w13_slope_percent", f"""{POS}, e AS (SELECT *, CASE WHEN pos >= 49 THEN {_ema('close', 50)} END AS e FROM x)
SELECT symbol, epoch(ts)::BIGINT AS ts, round((e - lag(e, 10) OVER w) / nullif(lag(e, 10) OVER w, 0), 6) AS slope FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    frame = V.smoothed(placed(spark, d), {"e": V.ema_spec("close", 50)})
    return frame.select("symbol", secs(), r6(V.change_rate("e", 10), "slope"))


@query("w25_ewma_variance", f"""{POS}, r AS (SELECT *, coalesce(pow(ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN pc > 0 THEN pc END), 2), 0) AS sq FROM x) SELECT symbol, epoch(ts)::BIGINT AS ts, round(6 * {_ema('sq', 20)}, 6) AS forecast FROM r""")
def _(spark, d):
    ln = lambda c: F.when(c > 0, F.ln(c))
    sq = F.coalesce(F.pow(ln(F.col("close")) - ln(F.lag("close").over(V.in_time())), 2), F.lit(0.0))
    frame = V.smoothed(placed(spark, d).withColumn("sq", sq), {"e": ("sq", 2 / 21, 1)})
    return frame.select("symbol", secs(), r6(6 * F.col("e"), "forecast"))


@query("w27_cross_signals", f"""{POS}, e AS (SELECT *, sign({_ema('close', 9)} - {_ema('close', 21)}) AS s FROM x), p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY symbol ORDER BY ts), 0) AS before FROM e)
SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN s > 0 AND before <= 0 THEN 1 ELSE -1 END AS direction FROM p WHERE (s > 0 AND before <= 0) OR (s < 0 AND before >= 0)""")
def _(spark, d):
    frame = V.smoothed(placed(spark, d), {"fast": ("close", 2 / 10, 1), "slow": ("close", 2 / 22, 1)})
    return G.crossings(frame).select("symbol", secs(), "direction")


@query("w05_regular_hours_vwap", f"""{POS}, r AS (SELECT *, et::DATE AS day FROM x WHERE hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960)
SELECT symbol, epoch(ts)::BIGINT AS ts, round(sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0), 6) AS vwap FROM r WINDOW d AS (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    minute = T.minute_of_day(T.eastern(F.col("ts")))
    return hourly(spark, d).where((minute >= 570) & (minute < 960)).select("symbol", secs(), r6(V.session_vwap(), "vwap"))


@query("g04_overnight_imbalance", f"""{POS}, n AS (SELECT *, hour(et) * 60 + minute(et) AS t FROM x), o AS (SELECT symbol, CASE WHEN t >= 960 THEN et::DATE + 1 ELSE et::DATE END AS day, volume * sign(close - open) AS sv FROM n WHERE t >= 960 OR t < 570)
SELECT symbol, day::VARCHAR AS day, sum(sv) AS imbalance FROM o GROUP BY symbol, day""")
def _(spark, d):
    return G.overnight_imbalance(hourly(spark, d)).select("symbol", F.col("day").cast("string").alias("day"), "imbalance")


_IMB = f"""{POS}, n AS (SELECT *, hour(et) * 60 + minute(et) AS t FROM x), o AS (SELECT symbol, CASE WHEN t >= 960 THEN et::DATE + 1 ELSE et::DATE END AS day, volume * sign(close - open) AS sv FROM n WHERE t >= 960 OR t < 570),
im AS (SELECT symbol, day, sum(sv) AS imbalance FROM o GROUP BY symbol, day), pl AS (SELECT *, list(abs(imbalance)) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM im),
pc AS (SELECT symbol, day, imbalance, CASE WHEN len(l) = 10 THEN (len(list_filter(l, lambda v: v < abs(imbalance))) + (len(list_filter(l, lambda v: v = abs(imbalance))) + 1) / 2.0) / 10 END AS p FROM pl)"""


@query("p17_overnight_signals", f"""{_IMB}, f AS (SELECT n.symbol, n.ts, n.et::DATE AS day, row_number() OVER (PARTITION BY n.symbol, n.et::DATE ORDER BY n.ts) AS rn FROM n WHERE t >= 570)
SELECT f.symbol, epoch(f.ts)::BIGINT AS ts, sign(imbalance)::INT AS direction FROM f JOIN pc ON pc.symbol = f.symbol AND pc.day = f.day WHERE rn = 1 AND p >= 0.75 AND imbalance <> 0""")
def _(spark, d):
    return G.overnight(hourly(spark, d), 0.75, 10).select("symbol", secs(), "direction")


@query("p19_vwap_reclaim", f"""{ATR}, v AS (SELECT z.*, close - sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0) AS dist FROM z WINDOW d AS (PARTITION BY symbol, et::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, CASE WHEN abs(dist) <= 0.15 * atr THEN 0 WHEN dist > atr THEN 1 WHEN dist < -atr THEN -1 END AS mark FROM v WHERE atr > 0 AND dist IS NOT NULL),
k AS (SELECT *, lag(mark) OVER (PARTITION BY symbol ORDER BY n) AS before FROM u WHERE mark IS NOT NULL) SELECT symbol, epoch(ts)::BIGINT AS ts, before AS direction FROM k WHERE mark = 0 AND before <> 0""")
def _(spark, d):
    return G.vwap_reclaim(with_atr(spark, d).withColumn("vwap", V.session_vwap())).select("symbol", secs(), "direction")


@query("p14_first_of_day", f"""{POS}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol, et::DATE ORDER BY ts) AS rn FROM x WHERE hour(et) * 60 + minute(et) >= 600) SELECT symbol, epoch(ts)::BIGINT AS ts, 1 AS long, -1 AS short FROM f WHERE rn = 1""")
def _(spark, d):
    return G.first_of_day(hourly(spark, d), 600).select("symbol", secs(), F.lit(1).alias("long"), F.lit(-1).alias("short"))


@query("p14_seeded_random")
def _(spark, d):
    return G.seeded_direction(G.first_of_day(hourly(spark, d), 600), 7).select("symbol", secs(), "direction")


@query("p20_bracket_sizes", f"""{_ENTRIES} SELECT id, round(price + CASE WHEN is_long THEN 1 ELSE -1 END * 1.5 * abs(price - stop), 6) AS target, CASE WHEN abs(price - stop) * 2.0 > 0 THEN least(floor(50000 * 0.005 / (abs(price - stop) * 2.0)), 20) ELSE 0 END::BIGINT AS size FROM e""")
def _(spark, d):
    _, rows = entries(spark, d)
    side = F.when(F.col("is_long"), 1).otherwise(-1)
    return rows.select("id", r6(F.col("price") + side * 1.5 * F.abs(F.col("price") - F.col("stop")), "target"), S.position_size(F.lit(50000.0), F.col("price"), F.col("stop"), 2.0, 0.005, 20).alias("size"))


@query("p06_stop_target_exits", f"""{_ENTRIES}, t AS (SELECT *, price + CASE WHEN is_long THEN 1 ELSE -1 END * 2.25 * abs(price - stop) / 1.5 AS target FROM e), h AS (SELECT t.id, any_value(t.pos) AS pos, min(b.pos) FILTER (WHERE CASE WHEN is_long THEN b.low <= stop ELSE b.high >= stop END) AS s, min(b.pos) FILTER (WHERE CASE WHEN is_long THEN b.high >= target ELSE b.low <= target END) AS g FROM t LEFT JOIN x b ON b.symbol = t.symbol AND b.pos > t.pos GROUP BY t.id)
SELECT id, CASE WHEN s IS NULL AND g IS NULL THEN 'open' WHEN g IS NULL OR s <= g THEN 'stop' ELSE 'target' END AS reason, least(coalesce(s, g), coalesce(g, s)) - pos AS bars FROM h""")
def _(spark, d):
    _, rows = entries(spark, d)
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    return G.stop_target(rows.withColumn("target", F.col("price") + side * 2.25 * F.abs(F.col("price") - F.col("stop")) / 1.5), placed(spark, d)).select("id", "reason", "bars")


@query("p08_time_exits", f"""{_ENTRIES}, l AS (SELECT symbol, max(pos) AS last FROM x GROUP BY symbol) SELECT id, b.pos - e.pos AS bars, round(CASE WHEN is_long THEN 1 ELSE -1 END * (b.close - price), 6) AS move FROM e JOIN l USING (symbol) JOIN x b ON b.symbol = e.symbol AND b.pos = least(e.pos + 10, last) WHERE last > e.pos""")
def _(spark, d):
    _, rows = entries(spark, d)
    line = V.rows(1, 10)
    ahead = placed(spark, d).select("symbol", "pos", F.last("close").over(line).alias("out"), F.count(F.lit(1)).over(line).alias("bars")).where("bars > 0")
    side = F.when(F.col("is_long"), 1).otherwise(-1)
    return rows.join(ahead, ["symbol", "pos"]).select("id", "bars", r6(side * (F.col("out") - F.col("price")), "move"))


@query("p03_session_ending", f"""{POS}, m AS (SELECT *, hour(et) * 60 + minute(et) AS t, lead(et::DATE) OVER (PARTITION BY symbol ORDER BY ts) AS nd FROM x) SELECT symbol, epoch(ts)::BIGINT AS ts, t + 60 >= 960 OR nd IS NULL OR nd <> et::DATE AS ending, (t >= 570 AND t < 690) OR (t >= 810 AND t < 960) AS allowed, NOT (((t >= 570 AND t < 690) OR (t >= 810 AND t < 960)) AND t + 60 < 960) AS off_hours FROM m""")
def _(spark, d):
    return G.session_flags(hourly(spark, d), [(570, 690), (810, 960)], 60).select("symbol", secs(), "ending", "allowed", "off_hours")


@query("p10_pullback_entries", f"""{ATR}, e AS (SELECT *, CASE WHEN pos >= 20 THEN {_ema('close', 21)} END AS e21, lag(close) OVER w AS c1, min(low) OVER l AS a, max(high) OVER l AS b FROM z WINDOW w AS (PARTITION BY symbol ORDER BY ts), l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT symbol, epoch(ts)::BIGINT AS ts, abs(close - e21) <= atr AS confluence FROM e WHERE atr > 0 AND e21 IS NOT NULL AND a < b AND close BETWEEN b - 0.618 * (b - a) AND b - 0.5 * (b - a) AND close > open""")
def _(spark, d):
    frame = V.smoothed(with_atr(spark, d), {"e21": V.ema_spec("close", 21)})
    frame = frame.withColumn("a", F.min("low").over(V.rows(-24, -1))).withColumn("b", F.max("high").over(V.rows(-24, -1)))
    return G.fib_pullback(frame).select("symbol", secs(), "confluence")


@query("f19_ema_confluence", f"""{ATR}, e AS (SELECT *, CASE WHEN pos >= 20 THEN {_ema('close', 21)} END AS e21 FROM z) SELECT symbol, epoch(ts)::BIGINT AS ts, coalesce(abs(close - e21) <= atr, false) AS near FROM e""")
def _(spark, d):
    frame = V.smoothed(with_atr(spark, d), {"e21": V.ema_spec("close", 21)})
    return frame.select("symbol", secs(), F.coalesce(S.has_confluence(F.col("close"), F.col("e21"), F.col("atr")), F.lit(False)).alias("near"))


@query("p12_reversal_entries", f"""{ATR}, e AS (SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1, min(low) OVER l AS a, max(high) OVER l AS b FROM z WINDOW w AS (PARTITION BY symbol ORDER BY ts), l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN low <= a + 0.25 * atr AND c1 < o1 AND close > open AND close >= o1 AND open <= c1 THEN 1 ELSE -1 END AS direction FROM e WHERE atr > 0 AND ((low <= a + 0.25 * atr AND c1 < o1 AND close > open AND close >= o1 AND open <= c1) OR (high >= b - 0.25 * atr AND c1 > o1 AND close < open AND close <= o1 AND open >= c1))""")
def _(spark, d):
    frame = with_atr(spark, d).withColumn("a", F.min("low").over(V.rows(-24, -1))).withColumn("b", F.max("high").over(V.rows(-24, -1)))
    return G.reversal(frame).select("symbol", secs(), "direction")


_EV = f"{ATR}, v AS (SELECT *, round((close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts)) / atr, 9) AS ev FROM z WHERE atr > 0)"


def expected(spark, d):
    return with_atr(spark, d).where("atr > 0").withColumn("ev", F.round((F.col("close") - F.lag("close", 5).over(V.in_time())) / F.col("atr"), 9))


@query("p25_hurdle_signals", f"{_EV} SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN ev > 1.5 THEN 1 WHEN ev < -1.5 THEN -1 ELSE 0 END AS direction FROM v WHERE ev IS NOT NULL")
def _(spark, d):
    return G.over_hurdle(expected(spark, d).where("ev is not null"), 1.5).select("symbol", secs(), "direction")


@query("p27_peak_confirm_selector")
def _(spark, d):
    signals = G.over_hurdle(expected(spark, d), 1.0).select("symbol", "ts", F.col("direction").cast("double").alias("direction"), F.abs("ev").alias("strength"))
    return P.peak_confirm(signals, 5).select("symbol", secs(), "direction")


@query("p32_entry_calendar")
def _(spark, d):
    frame = V.smoothed(placed(spark, d), {"fast": ("close", 2 / 10, 1), "slow": ("close", 2 / 22, 1)})
    marked = G.crossings(frame, keep=True).withColumn("day", F.to_date(T.eastern(F.col("ts")))).withColumn("flat", T.minute_of_day(T.eastern(F.col("ts"))) >= 955)
    return P.entry_calendar(marked).select("symbol", secs(), "direction")


@query("p34_shadow_book")
def _(spark, d):
    frame = G.over_hurdle(expected(spark, d), 1.0)
    return P.shadow_book(frame, stop_atr=1.5, slip=0.05, commission=0.1, most=500)


@query("p35_slippage_curve")
def _(spark, d):
    trades = P.shadow_book(G.over_hurdle(expected(spark, d), 1.0), stop_atr=1.5, slip=0.0, commission=0.1, most=500)
    return P.slippage_curve(trades, [0.0, 1.0, 2.0, 3.0, 5.0, 8.0], 0.25, 0.1).select("symbol", "ticks", "n", r6("mean_r", "mean_r"))


@query("p36_breakeven_slippage", f"""{POS}, c AS (SELECT symbol, unnest([0.0, 1.0, 2.0, 3.0, 5.0, 8.0]) AS slip, avg(abs(close - open)) AS m FROM x GROUP BY symbol), r AS (SELECT symbol, slip, m - slip * m / 2.5 AS result FROM c), l AS (SELECT *, lead(slip) OVER w AS s1, lead(result) OVER w AS r1 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY slip))
SELECT symbol, round(min(slip + (s1 - slip) * result / (result - r1)), 6) AS breakeven FROM l WHERE result > 0 AND r1 <= 0 GROUP BY symbol""")
def _(spark, d):
    mean = hourly(spark, d).groupBy("symbol").agg(F.avg(F.abs(F.col("close") - F.col("open"))).alias("m"))
    curve = mean.withColumn("slip", F.explode(F.array(*(F.lit(x) for x in (0.0, 1.0, 2.0, 3.0, 5.0, 8.0))))).withColumn("result", F.col("m") - F.col("slip") * F.col("m") / 2.5)
    return P.breakeven(curve, ["symbol"]).select("symbol", r6("breakeven", "breakeven"))


@query("p38_decision_overlay", f"""{_ENTRIES}, u AS (SELECT id, symbol, pos, CASE WHEN pos % 3 = 0 THEN 'taken' ELSE 'skipped' END AS choice, pos AS at FROM e UNION ALL SELECT id, symbol, pos, 'skipped', pos + 10 FROM e WHERE pos % 4 = 0), l AS (SELECT id, arg_max(choice, at) AS choice FROM u GROUP BY id)
SELECT symbol, choice, count(*) AS n FROM l JOIN e USING (id) GROUP BY ALL""".replace(" AS at ", " AS tm ").replace("choice, at)", "choice, tm)"))
def _(spark, d):
    _, rows = entries(spark, d)
    marks = rows.select("id", "symbol", F.when(F.col("pos") % 3 == 0, "taken").otherwise("skipped").alias("choice"), F.col("pos").alias("at"))
    marks = marks.unionByName(rows.where("pos % 4 = 0").select("id", "symbol", F.lit("skipped").alias("choice"), (F.col("pos") + 10).alias("at")))
    return marks.groupBy("id", "symbol").agg(F.max_by("choice", "at").alias("choice")).groupBy("symbol", "choice").agg(F.count("*").alias("n"))


@query("x05_daily_limits", f"""{_ENTRIES}, t AS (SELECT e.symbol, e.pos, x.et::DATE AS day, CASE WHEN is_long THEN 1 ELSE -1 END * (lead(x.close, 2) OVER (PARTITION BY e.symbol ORDER BY e.pos) - price) AS pnl FROM e JOIN x ON x.symbol = e.symbol AND x.pos = e.pos), u AS (SELECT * FROM t WHERE pnl IS NOT NULL),
r AS (SELECT *, coalesce(sum(pnl) OVER p, 0) AS before, count(*) OVER p AS taken, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS wins FROM u WINDOW p AS (PARTITION BY symbol, day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, pos, before > -100 AND taken < 5 AND NOT (taken >= 3 AND coalesce(wins, 0) = 0) AS allowed FROM r""")
def _(spark, d):
    _, rows = entries(spark, d)
    days = placed(spark, d).select("symbol", "pos", F.to_date(T.eastern(F.col("ts"))).alias("day"), "close")
    joined = rows.join(days, ["symbol", "pos"])
    pnl = F.when(F.col("is_long"), 1).otherwise(-1) * (F.lead("close", 2).over(Window.partitionBy("symbol").orderBy("pos")) - F.col("price"))
    return S.within_daily_limits(joined.withColumn("pnl", pnl).where("pnl is not null"), 100.0, 5, 3).select("symbol", F.col("pos").cast("long").alias("pos"), "allowed")


@query("x04_reward_gate", f"{_ENTRIES} SELECT id, round(2.25 / 1.5, 6) AS rr, 2.25 / 1.5 >= 1.5 AS passes, round((0.5 + 2 * 0.25) * 2.0 + 1.0, 6) AS cost FROM e")
def _(spark, d):
    _, rows = entries(spark, d)
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    ratio = F.round(S.reward_risk(F.col("price"), F.col("stop"), F.col("price") + side * 2.25 * F.abs(F.col("price") - F.col("stop")) / 1.5), 6)
    return rows.select("id", ratio.alias("rr"), (ratio >= 1.5).alias("passes"), F.round(S.round_trip_cost(1.0, 0.5, 0.25, 1.0, 2.0), 6).alias("cost"))


@query("x07_percentile_buckets", f"""{POS}, p AS (SELECT symbol, ts, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM x), q AS (SELECT *, CASE WHEN len(l) = 20 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0) / 20 END AS p FROM p)
SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN p IS NULL THEN 'unknown' ELSE ['low', 'mid', 'high'][least(3, floor(p * 3)::INT + 1)] END AS bucket FROM q""")
def _(spark, d):
    frame = hourly(spark, d).withColumn("p", V.percent_rank_within("close", 20))
    return frame.select("symbol", secs(), S.percentile_bucket(F.col("p"), ["low", "mid", "high"]).alias("bucket"))


@query("x21_zones", f"""{POS}, r AS (SELECT *, max(high) OVER w AS h, min(low) OVER w AS l FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN close > (l + h) / 2 THEN 'premium' WHEN close < (l + h) / 2 THEN 'discount' ELSE 'equilibrium' END AS zone FROM r""")
def _(spark, d):
    frame = hourly(spark, d).withColumn("h", F.max("high").over(V.rows(-23, 0))).withColumn("l", F.min("low").over(V.rows(-23, 0)))
    return frame.select("symbol", secs(), S.zone(F.col("close"), F.col("l"), F.col("h")).alias("zone"))


_SCENES = f"""{ATR}, sc AS (SELECT symbol, pos, ts, et, atr, abs(close - open) / atr AS body, (high - low) / atr AS span, least(volume / 10.0, 1) AS busy FROM z WHERE atr > 0),
iv AS (SELECT *, round(0.5 * least(body, 2) / 2 + 0.3 * least(span, 3) / 3 + 0.2 * busy, 9) AS value, round(0.7 * greatest(0, 1 - abs(body - 1)) + 0.3 * busy, 9) AS selectivity, body < 0.1 AND span < 0.5 AS trivial FROM sc)"""


def scenes(spark, d):
    return G.scene_scores(with_atr(spark, d).where("atr > 0"))


@query("x18_scene_values", f"{_SCENES} SELECT symbol, pos, round(value, 6) AS value, round(selectivity, 6) AS selectivity, trivial FROM iv")
def _(spark, d):
    return scenes(spark, d).select("symbol", F.col("pos").cast("long").alias("pos"), r6("value", "value"), r6("selectivity", "selectivity"), "trivial")


@query("t02_one_scene_per_day", f"{_SCENES}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol, et::DATE ORDER BY ts) AS rn FROM iv WHERE NOT trivial) SELECT symbol, pos, round(selectivity, 6) AS selectivity FROM f WHERE rn = 1 ORDER BY f.selectivity DESC, symbol, pos LIMIT 30")
def _(spark, d):
    day = Window.partitionBy("symbol", F.to_date(T.eastern(F.col("ts")))).orderBy("ts")
    first = scenes(spark, d).where("not trivial").withColumn("rn", F.row_number().over(day)).where("rn = 1")
    return first.orderBy(F.col("selectivity").desc(), "symbol", "pos").limit(30).select("symbol", F.col("pos").cast("long").alias("pos"), r6("selectivity", "selectivity"))


@query("t04_latest_signals", f"{_EV} SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN ev > 1.5 THEN 1 ELSE -1 END AS direction FROM v WHERE abs(ev) > 1.5 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20")
def _(spark, d):
    signals = G.over_hurdle(expected(spark, d), 1.5).where("direction <> 0")
    return signals.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))).where("rn <= 20").select("symbol", secs(), "direction")


@query("j21_fresh_scenes", f"{_SCENES} SELECT symbol, pos FROM iv WHERE value >= 0.3 AND NOT EXISTS (SELECT 1 FROM iv o WHERE o.symbol = iv.symbol AND o.pos = iv.pos AND o.trivial)")
def _(spark, d):
    found = scenes(spark, d)
    return found.where("value >= 0.3").join(found.where("trivial").select("symbol", "pos"), ["symbol", "pos"], "left_anti").select("symbol", F.col("pos").cast("long").alias("pos"))
