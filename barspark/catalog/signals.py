"""Event patterns, first hits and strategy signals over hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import _SWING, KEY, hourly, placed, r6, secs, swings, with_atr
from barspark.catalog.sql import ATR, BARS, POS
from barspark.functions import scalars as S
from barspark.functions import session as T
from barspark.operators import bars as B
from barspark.operators import firsthit as H
from barspark.operators import structure as D
from barspark.operators import windows as V
from barspark.plans import simulation as P
from barspark.plans import strategies as G


@query("d01_swing_structure", f"""{_SWING}, p AS (SELECT *, list(high) FILTER (WHERE sh) OVER c AS hs, list(low) FILTER (WHERE sl) OVER c AS ls FROM s WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))
SELECT {KEY}, CASE WHEN hs[-1] > hs[-2] AND ls[-1] > ls[-2] THEN 'HH_HL' WHEN hs[-1] < hs[-2] AND ls[-1] < ls[-2] THEN 'LH_LL' ELSE 'mixed' END AS structure,
  CASE WHEN close > ch THEN 'up' WHEN close < cl THEN 'down' END AS bos FROM p""")
def _(spark, d):
    frame = swings(spark, d).withColumn("h", V.last_pivots("sh", "high", 2, 2)).withColumn("l", V.last_pivots("sl", "low", 2, 2))
    h, l = (lambda i: F.col("h")[i]["high"]), (lambda i: F.col("l")[i]["low"])  # noqa: E741
    structure = F.when((h(1) > h(0)) & (l(1) > l(0)), "HH_HL").when((h(1) < h(0)) & (l(1) < l(0)), "LH_LL").otherwise("mixed")
    bos = F.when(F.col("close") > F.col("ch"), "up").when(F.col("close") < F.col("cl"), "down")
    return frame.select("symbol", secs(), structure.alias("structure"), bos.alias("bos"))


@query("d09_triple_barrier", f"""{ATR}, e AS (SELECT *, close + 1.0 * atr AS u, close - 1.0 * atr AS d FROM z),
j AS (SELECT e.symbol, e.ts, e.pos, e.close, e.u, e.d, count(b.pos) AS have, min(b.pos - e.pos) FILTER (WHERE b.high >= e.u) AS ui, min(b.pos - e.pos) FILTER (WHERE b.low <= e.d) AS di
  FROM e LEFT JOIN x b ON b.symbol = e.symbol AND b.pos > e.pos AND b.pos <= e.pos + 6 GROUP BY ALL),
o AS (SELECT *, CASE WHEN have = 0 OR u IS NULL THEN NULL WHEN ui IS NULL AND di IS NULL THEN 'timeout' WHEN ui = di THEN 'ambiguous' WHEN coalesce(ui, 99) < coalesce(di, 99) THEN 'up' ELSE 'down' END AS outcome FROM j)
SELECT o.symbol, epoch(o.ts)::BIGINT AS ts, outcome, CASE WHEN outcome IS NOT NULL THEN least(coalesce(ui, 99), coalesce(di, 99), have) END AS steps,
  round(CASE outcome WHEN 'up' THEN u WHEN 'down' THEN d ELSE CASE WHEN outcome IS NOT NULL THEN b.close END END - o.close, 6) AS move
FROM o LEFT JOIN x b ON b.symbol = o.symbol AND b.pos = o.pos + least(coalesce(ui, 99), coalesce(di, 99), have)""")
def _(spark, d):
    frame = with_atr(spark, d)
    out = H.triple_barrier(frame, F.col("close") + F.col("atr"), F.col("close") - F.col("atr"), 6)
    return out.select("symbol", secs(), "outcome", F.col("steps").cast("long").alias("steps"), r6("move", "move"))


_PIVOTS = f"""{POS}, fr AS (
  SELECT *, count(*) OVER a = 2 AND count(*) OVER b = 2 AND high > max(high) OVER b AND high >= max(high) OVER a AS top, count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER b AND low <= min(low) OVER a AS bottom
  FROM x WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)
), pv AS (SELECT symbol, pos, 1 AS kind, high AS price FROM fr WHERE top UNION ALL SELECT symbol, pos, -1, low FROM fr WHERE bottom)"""
_POOLS = f"""{_PIVOTS}, hit AS (
  SELECT p.symbol, p.pos, p.kind, min(b.pos) AS hit_pos, arg_min(b.close, b.pos) AS hit_close, arg_min(CASE WHEN p.kind = 1 THEN b.high ELSE b.low END, b.pos) AS extreme
  FROM pv p JOIN x b ON b.symbol = p.symbol AND b.pos > p.pos + 2 AND CASE WHEN p.kind = 1 THEN b.high > p.price ELSE b.low < p.price END GROUP BY ALL
), pool AS (SELECT pv.*, hit_pos, hit_close, extreme, coalesce(CASE WHEN pv.kind = 1 THEN hit_close < price ELSE hit_close > price END, false) AS swept FROM pv LEFT JOIN hit USING (symbol, pos, kind))"""


@query("d11_skeleton", f"""{_PIVOTS}, m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER o THEN 1 ELSE 0 END AS ch FROM pv WINDOW o AS (PARTITION BY symbol ORDER BY pos, kind)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT symbol, run, kind, first(pos ORDER BY kind * price DESC, pos) AS pos, first(price ORDER BY kind * price DESC, pos) AS price FROM r GROUP BY ALL)
SELECT symbol, pos, kind, price, coalesce(kind * price > kind * lag(price) OVER k, true) AND coalesce(kind * price > kind * lead(price) OVER k, true) AS dominant FROM g WINDOW k AS (PARTITION BY symbol, kind ORDER BY pos)""")
def _(spark, d):
    return D.skeleton(D.pivots(placed(spark, d))).select("symbol", F.col("pos").cast("long").alias("pos"), "kind", "price", "dominant")


@query("d12_liquidity_pools", f"{_POOLS} SELECT symbol, pos, kind, price, hit_pos, swept FROM pool")
def _(spark, d):
    bars = placed(spark, d)
    return D.pools(D.pivots(bars), bars).select("symbol", F.col("pos").cast("long").alias("pos"), "kind", "price", F.col("hit_pos").cast("long").alias("hit_pos"), "swept")


@query("d16_sweeps", f"{_POOLS} SELECT symbol, pos, kind, hit_pos, extreme FROM pool WHERE swept")
def _(spark, d):
    bars = placed(spark, d)
    return D.pools(D.pivots(bars), bars).where("swept").select("symbol", F.col("pos").cast("long").alias("pos"), "kind", F.col("hit_pos").cast("long").alias("hit_pos"), "extreme")


@query("d17_displacements", f"""{_POOLS}, n AS (SELECT q.symbol, q.pos, q.kind, any_value(q.hit_pos) AS hit_pos, any_value(q.extreme) AS extreme, min(v.pos) AS end_pos, arg_min(v.price, v.pos) AS end_price
  FROM pool q JOIN pv v ON v.symbol = q.symbol AND v.kind = -q.kind AND v.pos > q.hit_pos WHERE q.swept GROUP BY q.symbol, q.pos, q.kind)
SELECT symbol, pos, kind, end_pos, round(abs(end_price - extreme), 6) AS net_move, end_pos - hit_pos AS bars FROM n""")
def _(spark, d):
    bars = placed(spark, d)
    found = D.pivots(bars)
    out = D.displacements(D.pools(found, bars), found)
    return out.select("symbol", *(F.col(c).cast("long").alias(c) for c in ("pos", "kind", "end_pos", "bars")), r6("net_move", "net_move"))


@query("d18_structure_shifts", f"""{_POOLS}, f AS (SELECT q.symbol, q.pos, q.kind, q.hit_pos, max(v.pos) AS ref_pos, arg_max(v.price, v.pos) AS ref_price FROM pool q JOIN pv v ON v.symbol = q.symbol AND v.kind = -q.kind AND v.pos < q.hit_pos WHERE q.swept GROUP BY ALL)
SELECT f.symbol, f.pos, f.kind, f.ref_pos, min(b.pos) AS mss_pos FROM f LEFT JOIN x b ON b.symbol = f.symbol AND b.pos > f.hit_pos AND CASE WHEN f.kind = 1 THEN b.close < f.ref_price ELSE b.close > f.ref_price END GROUP BY ALL""")
def _(spark, d):
    bars = placed(spark, d)
    found = D.pivots(bars)
    out = D.shifts(D.pools(found, bars), found, bars)
    return out.select("symbol", *(F.col(c).cast("long").alias(c) for c in ("pos", "kind", "ref_pos", "mss_pos")))


@query("d19_fair_value_gaps", f"""{POS}, g AS (SELECT *, lag(high, 2) OVER w AS h0, lag(low, 2) OVER w AS l0 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
f AS (SELECT symbol, pos, CASE WHEN low > h0 THEN 1 ELSE -1 END AS side, CASE WHEN low > h0 THEN h0 ELSE high END AS bottom, CASE WHEN low > h0 THEN low ELSE l0 END AS top FROM g WHERE low > h0 OR high < l0)
SELECT f.symbol, f.pos, f.side, f.bottom, f.top, min(b.pos) FILTER (WHERE CASE WHEN side = 1 THEN b.low <= top ELSE b.high >= bottom END) AS touch_pos, min(b.pos) FILTER (WHERE CASE WHEN side = 1 THEN b.low <= bottom ELSE b.high >= top END) AS fill_pos
FROM f LEFT JOIN x b ON b.symbol = f.symbol AND b.pos > f.pos GROUP BY ALL""")
def _(spark, d):
    return D.gaps(placed(spark, d)).select("symbol", F.col("pos").cast("long").alias("pos"), "side", "bottom", "top", F.col("touch_pos").cast("long").alias("touch_pos"), F.col("fill_pos").cast("long").alias("fill_pos"))


@query("d14_dealing_range", f"""{_PIVOTS}, m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER o THEN 1 ELSE 0 END AS ch FROM pv WINDOW o AS (PARTITION BY symbol ORDER BY pos, kind)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT symbol, run, kind, first(pos ORDER BY kind * price DESC, pos) AS pos, first(price ORDER BY kind * price DESC, pos) AS price FROM r GROUP BY ALL),
e AS (SELECT symbol, arg_max(price, pos) FILTER (WHERE kind = 1) AS range_high, arg_max(price, pos) FILTER (WHERE kind = -1) AS range_low FROM g GROUP BY symbol)
SELECT e.*, round((range_high + range_low) / 2, 6) AS equilibrium, CASE WHEN l.c > (range_high + range_low) / 2 THEN 'premium' WHEN l.c < (range_high + range_low) / 2 THEN 'discount' ELSE 'equilibrium' END AS zone
FROM e JOIN (SELECT symbol, arg_max(close, pos) AS c FROM x GROUP BY symbol) l USING (symbol)""")
def _(spark, d):
    bars = placed(spark, d)
    last = bars.groupBy("symbol").agg(F.max_by("close", "pos").alias("c"))
    out = D.dealing_range(D.skeleton(D.pivots(bars))).join(last, "symbol")
    return out.select("symbol", "range_high", "range_low", r6("equilibrium", "equilibrium"), S.zone(F.col("c"), F.col("range_low"), F.col("range_high")).alias("zone"))


@query("w32_ranked_sweeps", f"""{_POOLS}, q AS (SELECT symbol, pos, kind, round(abs(extreme - price), 6) AS depth, hit_pos - pos AS age FROM pool WHERE swept)
SELECT symbol, pos, kind, depth, row_number() OVER (PARTITION BY symbol ORDER BY depth DESC, age DESC, pos, kind) AS rank, count(*) OVER (PARTITION BY symbol, depth, age) > 1 AS tied FROM q""")
def _(spark, d):
    bars = placed(spark, d)
    swept = D.pools(D.pivots(bars), bars).where("swept").withColumn("depth", r6(F.abs(F.col("extreme") - F.col("price")))).withColumn("age", F.col("hit_pos") - F.col("pos")).withColumn("seq", F.struct("pos", "kind"))
    out = D.ranked(swept, ["symbol"], ["depth", "age"], "seq")
    return out.select("symbol", F.col("pos").cast("long").alias("pos"), "kind", "depth", F.col("rank").cast("long").alias("rank"), "tied")


@query("d28_ancestors", f"""{_POOLS}, e AS (SELECT 'sweep:' || symbol || ':' || pos || ':' || kind AS child, 'pivot:' || symbol || ':' || pos || ':' || kind AS parent FROM pool WHERE swept
  UNION ALL SELECT 'pivot:' || symbol || ':' || pos || ':' || kind, 'bar:' || symbol || ':' || pos FROM pv),
t AS (SELECT child AS root, child AS node, 0 AS depth FROM e WHERE child LIKE 'sweep%' UNION SELECT t.root, e.parent, t.depth + 1 FROM t JOIN e ON e.child = t.node)
SELECT root, node, min(depth) AS depth FROM t GROUP BY root, node""")
def _(spark, d):
    bars = placed(spark, d)
    found = D.pivots(bars)
    swept = D.pools(found, bars).where("swept")
    pivot = F.concat_ws(":", F.lit("pivot"), "symbol", "pos", "kind")
    a = swept.select(F.concat_ws(":", F.lit("sweep"), "symbol", "pos", "kind").alias("child"), pivot.alias("parent"))
    b = found.select(pivot.alias("child"), F.concat_ws(":", F.lit("bar"), "symbol", "pos").alias("parent"))
    return D.ancestors(a.unionByName(b), a.select(F.col("child").alias("root"), F.col("child").alias("node"))).withColumn("depth", F.col("depth").cast("long"))


_DAILY = "dd AS (SELECT o_orderstatus AS symbol, o_orderdate::DATE AS day, first(o_totalprice ORDER BY o_orderkey) AS open, last(o_totalprice ORDER BY o_orderkey) AS close FROM orders GROUP BY ALL)"
_ROLLS = f"""WITH {_DAILY}, g AS (SELECT *, abs(open - lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS gap, (date_trunc('quarter', day) + INTERVAL 2 MONTH)::DATE AS m FROM dd),
n AS (SELECT *, (m + ((5 - isodow(m) + 7) % 7 + 14)::INT - 8)::DATE AS nominal FROM g),
r AS (SELECT symbol, nominal, first(day ORDER BY gap DESC, day) AS day, max(gap) AS gap FROM n WHERE gap IS NOT NULL AND abs(day - nominal) <= 5 GROUP BY symbol, nominal)"""


def daily_orders(spark, d):
    from barspark.sources import tables

    orders = tables.table(spark, d, "orders")
    return orders.groupBy(F.col("o_orderstatus").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"))


@query("d37_rolls", f"{_ROLLS} SELECT symbol, nominal::VARCHAR AS nominal, day::VARCHAR AS day, round(gap, 6) AS gap FROM r")
def _(spark, d):
    return D.rolls(daily_orders(spark, d)).select("symbol", F.col("nominal").cast("string").alias("nominal"), F.col("day").cast("string").alias("day"), r6("gap", "gap"))


@query("d38_roll_segments", f"{_ROLLS}, s AS (SELECT dd.symbol, count(r.day) OVER (PARTITION BY dd.symbol ORDER BY dd.day ROWS UNBOUNDED PRECEDING) AS segment FROM dd LEFT JOIN r ON r.symbol = dd.symbol AND r.day = dd.day) SELECT symbol, segment, count(*) AS days FROM s GROUP BY ALL")
def _(spark, d):
    daily = daily_orders(spark, d)
    return D.segments(daily, D.rolls(daily)).groupBy("symbol", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("days"))


_ENTRIES = f"{ATR}, e AS (SELECT symbol || ':' || pos AS id, symbol, pos, close > open AS is_long, close AS price, CASE WHEN close > open THEN close - 1.5 * atr ELSE close + 1.5 * atr END AS stop FROM z WHERE atr > 0 AND close <> open)"


def entries(spark, d):
    frame = with_atr(spark, d).where("atr > 0 and close <> open")
    long = F.col("close") > F.col("open")
    return frame, frame.select(F.concat_ws(":", "symbol", "pos").alias("id"), "symbol", "pos", long.alias("is_long"), F.col("close").alias("price"), F.when(long, F.col("close") - 1.5 * F.col("atr")).otherwise(F.col("close") + 1.5 * F.col("atr")).alias("stop"))


@query("d33_fixed_exit_models", f"""{_ENTRIES}, c AS (SELECT e.*, b.pos - e.pos AS k, CASE WHEN is_long THEN b.high - price ELSE price - b.low END / abs(price - stop) AS best, CASE WHEN is_long THEN b.low <= stop ELSE b.high >= stop END AS st,
  CASE WHEN is_long THEN 1 ELSE -1 END * (b.close - price) / abs(price - stop) AS mk FROM e JOIN x b ON b.symbol = e.symbol AND b.pos > e.pos AND b.pos <= e.pos + 24),
g AS (SELECT id, min(k) FILTER (WHERE st) AS s, min(k) FILTER (WHERE best >= 2) AS h2, min(k) FILTER (WHERE best >= 3) AS h3, arg_max(mk, k) AS mark FROM c GROUP BY id)
SELECT id, round(CASE WHEN h2 IS NULL AND s IS NULL THEN mark WHEN coalesce(h2, 999) < coalesce(s, 999) THEN 2 ELSE -1 END, 6) AS r_2, round(CASE WHEN h3 IS NULL AND s IS NULL THEN mark WHEN coalesce(h3, 999) < coalesce(s, 999) THEN 3 ELSE -1 END, 6) AS r_3 FROM g""")
def _(spark, d):
    _, rows = entries(spark, d)
    out = H.fixed_target(rows, placed(spark, d), [2.0, 3.0], 24)
    return out.select("id", r6("r_0", "r_2"), r6("r_1", "r_3"))


@query("x01_risk_scalars", f"""{_ENTRIES}, t AS (SELECT *, CASE WHEN is_long THEN price + 2.25 * abs(price - stop) / 1.5 ELSE price - 2.25 * abs(price - stop) / 1.5 END AS target FROM e)
SELECT id, least(floor(50000 * 0.005 / (abs(price - stop) * 2.0)), 20)::BIGINT AS size, round(abs(target - price) / abs(price - stop), 6) AS rr, round(CASE WHEN is_long THEN price + 0.5 ELSE price - 0.5 END, 6) AS fill, round(floor(price / 0.25 + 0.5) * 0.25, 4) AS tick FROM t""")
def _(spark, d):
    _, rows = entries(spark, d)
    p, s, long = F.col("price"), F.col("stop"), F.col("is_long")
    target = F.when(long, p + 2.25 * F.abs(p - s) / 1.5).otherwise(p - 2.25 * F.abs(p - s) / 1.5)
    return rows.select("id", S.position_size(F.lit(50000.0), p, s, 2.0, 0.005, 20).alias("size"), r6(S.reward_risk(p, s, target), "rr"), r6(S.slipped(p, long, True, 0.5), "fill"), S.round_to_tick(p, 0.25).alias("tick"))


@query("p15_liquidity_sweep_signals", f"{_SWING} SELECT {KEY}, CASE WHEN high > ch AND close < ch THEN -1 WHEN low < cl AND close > cl THEN 1 END AS direction FROM s WHERE (high > ch AND close < ch) OR (low < cl AND close > cl)")
def _(spark, d):
    return G.liquidity_sweep(swings(spark, d)).where("direction is not null").select("symbol", secs(), "direction")


@query("p16_opening_gap_signals", f"""{ATR}, g AS (SELECT symbol, et::DATE AS day, last(close ORDER BY ts) FILTER (WHERE hour(et) < 16) AS dc FROM x GROUP BY ALL),
f AS (SELECT z.*, g.dc, row_number() OVER (PARTITION BY z.symbol, z.et::DATE ORDER BY z.ts) AS rn FROM z LEFT JOIN g ON g.symbol = z.symbol AND g.day + 1 = z.et::DATE WHERE hour(z.et) * 60 + minute(z.et) >= 570)
SELECT {KEY}, CASE WHEN open > dc THEN 1 ELSE -1 END AS direction FROM f WHERE rn = 1 AND abs(open - dc) >= 0.5 * atr AND atr > 0""")
def _(spark, d):
    return G.opening_gap(with_atr(spark, d), 0.5).select("symbol", secs(), "direction")


@query("p13_opening_range_breakout", f"""{POS}, m AS (SELECT *, hour(et) * 60 + minute(et) AS t, et::DATE AS day FROM x), o AS (SELECT symbol, day, max(high) AS oh, min(low) AS ol FROM m WHERE t >= 540 AND t < 660 GROUP BY ALL),
b AS (SELECT m.*, oh, ol, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS rn FROM m JOIN o USING (symbol, day) WHERE t >= 660 AND t < 900 AND (high > oh OR low < ol))
SELECT {KEY}, CASE WHEN high > oh THEN 1 ELSE -1 END AS direction, CASE WHEN high > oh THEN oh ELSE ol END AS entry, CASE WHEN high > oh THEN ol ELSE oh END AS stop FROM b WHERE rn = 1""")
def _(spark, d):
    return G.opening_range_breakout(hourly(spark, d), (540, 660), 900).select("symbol", secs(), "direction", "entry", "stop")


@query("p18_pullback_signals", f"""{POS}, m AS (SELECT *, list_reduce(list(close) OVER u, lambda a, b: a + 2.0 / 21 * (b - a)) AS fast, list_reduce(list(close) OVER u, lambda a, b: a + 2.0 / 51 * (b - a)) AS slow FROM x WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CASE WHEN pos >= 49 THEN slow END AS s50, CASE WHEN pos >= 19 THEN fast END AS s20 FROM m), s AS (SELECT *, (s50 - lag(s50, 10) OVER w) / lag(s50, 10) OVER w AS slope FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT {KEY}, CASE WHEN slope > 0 THEN 1 ELSE -1 END AS direction FROM s WHERE abs(slope) >= 0.001 AND s20 IS NOT NULL AND CASE WHEN slope > 0 THEN pc <= s20 AND close > s20 ELSE pc >= s20 AND close < s20 END""")
def _(spark, d):
    frame = V.smoothed(placed(spark, d), {"fast": V.ema_spec("close", 20), "slow": V.ema_spec("close", 50)})
    return G.pullback(frame, 0.001, 10).select("symbol", secs(), "direction")


@query("p21_horizon_policies", f"""{POS}, v AS (SELECT *, sign(close - lag(close, 1) OVER w) AS d1, sign(close - lag(close, 5) OVER w) AS d5, sign(close - lag(close, 20) OVER w) AS d20, least(abs(close - lag(close, 1) OVER w) / 100, 1) AS c1, least(abs(close - lag(close, 5) OVER w) / 100, 1) AS c5, least(abs(close - lag(close, 20) OVER w) / 100, 1) AS c20 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT {KEY}, CASE WHEN d1 = d5 AND d5 = d20 AND least(c1, c5, c20) >= 0.1 THEN d1 END AS agreement, CASE WHEN abs(c1 * d1 + c5 * d5 + c20 * d20) >= 0.3 THEN sign(c1 * d1 + c5 * d5 + c20 * d20) END AS weighted,
  CASE WHEN c1 >= c5 AND c1 >= c20 THEN d1 WHEN c5 >= c20 THEN d5 ELSE d20 END AS most_sure, d20 AS longest FROM v WHERE d20 IS NOT NULL""")
def _(spark, d):
    frame = placed(spark, d)
    for n in (1, 5, 20):
        move = F.col("close") - F.lag("close", n).over(V.in_time())
        frame = frame.withColumn(f"d{n}", F.signum(move)).withColumn(f"c{n}", F.least(F.abs(move) / 100, F.lit(1.0)))
    return G.horizon_policies(frame.where("d20 is not null"), ["1", "5", "20"], 0.1, 0.3).select("symbol", secs(), "agreement", "weighted", "most_sure", "longest")


@query("p28_window_max_selector", f"""{POS}, s AS (SELECT *, close - open AS strength, pos // 12 AS w FROM x WHERE close <> open)
SELECT symbol, w AS bucket, max((pos // 12) * 12 + 11) AS decided_pos, first(sign(strength) ORDER BY abs(strength) DESC, pos) AS direction FROM s GROUP BY symbol, w""")
def _(spark, d):
    frame = placed(spark, d).withColumn("direction", F.signum(F.col("close") - F.col("open"))).withColumn("strength", F.abs(F.col("close") - F.col("open"))).where("direction <> 0")
    return G.window_max(frame, 12).select("symbol", "bucket", "decided_pos", "direction")


@query("p26_rising_edge_selector")
def _(spark, d):
    frame = placed(spark, d).withColumn("direction", F.signum(F.col("close") - F.col("open")))
    return P.rising_edge(frame, cooldown=3).select("symbol", secs(), "direction")


@query("p29_alert_risk_policy")
def _(spark, d):
    frame = H.triple_barrier(with_atr(spark, d), F.col("close") + F.col("atr"), F.col("close") - F.col("atr"), 6)
    long = F.col("close") > F.col("open")
    candidates = frame.where("outcome is not null and close <> open").select(
        "symbol", "pos", (F.col("pos") + F.col("steps")).alias("exit_pos"), F.to_date(T.eastern(F.col("ts"))).cast("string").alias("day"), long.alias("is_long"),
        F.col("close").alias("entry"), (F.col("close") - F.when(long, 1).otherwise(-1) * F.col("atr")).alias("stop"), (F.col("close") + F.col("move")).alias("exit"),
    )
    return P.risk_policy(candidates, point_value=0.5)


@query("p01_backtest")
def _(spark, d):
    signals = G.liquidity_sweep(swings(spark, d)).select("symbol", "ts", "direction")
    bars = with_atr(spark, d).join(signals, ["symbol", "ts"])
    return P.backtest(bars, P.BacktestConfig())


@query("p33_channel_overlay")
def _(spark, d):
    frame = with_atr(spark, d)
    marks = frame.withColumn("direction", F.when(F.col("close") != F.col("open"), F.signum(F.col("close") - F.col("open"))))
    return P.channel(marks, k=2.0, m=3.0, slip=0.05)


@query("p37_trade_tracker")
def _(spark, d):
    _, rows = entries(spark, d)
    return P.track(rows, placed(spark, d), target=2.0, horizon=96)
