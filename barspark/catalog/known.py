"""What the setup chain knew at every hourly bar, beside SQL that runs the chain at every bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import placed, r6
from barspark.catalog.setups import _CHAIN, _DAY
from barspark.plans import stall
from barspark.plans.causal import Known

#: Every displacement known at every bar, with the structural swing before its sweep as of that bar.
_KNOWN = f"""{_CHAIN}, lv0 AS (SELECT *, max(kind * price) OVER (PARTITION BY symbol, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sr),
lv AS (SELECT symbol, run, kind, pos, price, pos + 2 AS kf, coalesce(lead(pos) OVER (PARTITION BY symbol, run ORDER BY pos) + 2, 1000000000) AS kt FROM lv0 WHERE best IS NULL OR kind * price > best),
mk0 AS (SELECT b.symbol, b.pos AS c, m.level_pos, m.way, m.sweep_pos, m.extreme, CASE WHEN m.turn_pos < b.pos THEN m.turn_pos ELSE b.pos END AS end_pos FROM mv0 m JOIN x b ON b.symbol = m.symbol AND m.sweep_pos < b.pos),
mk AS (SELECT k.* FROM mk0 k JOIN x e ON e.symbol = k.symbol AND e.pos = k.end_pos WHERE CASE WHEN way = 1 THEN e.high > extreme ELSE e.low < extreme END),
cs AS (SELECT m.symbol, c, m.level_pos, m.way, m.sweep_pos, m.end_pos, m.extreme, max(lv.pos) AS broken_pos, arg_max(lv.price, lv.pos) AS broken_price
  FROM mk m JOIN lv ON lv.symbol = m.symbol AND lv.kind = m.way AND lv.pos < m.sweep_pos AND lv.kf <= c AND lv.kt > c GROUP BY ALL),
cd AS (SELECT d.*, min(b.pos) AS confirm_pos FROM (SELECT DISTINCT symbol, level_pos, way, sweep_pos, broken_pos, broken_price FROM cs) d JOIN x b ON b.symbol = d.symbol AND b.pos > d.sweep_pos AND CASE WHEN d.way = 1 THEN b.close > broken_price ELSE b.close < broken_price END GROUP BY ALL),
ct AS (SELECT cs.*, CASE WHEN confirm_pos <= c THEN confirm_pos ELSE broken_pos END AS placed FROM cs LEFT JOIN cd USING (symbol, level_pos, way, sweep_pos, broken_pos, broken_price)),
go AS (SELECT cs.symbol, c, formed_pos, cs.way, sweep_pos, level_pos, extreme, bottom, top, (top + bottom) / 2 AS entry FROM cs JOIN gf ON gf.symbol = cs.symbol AND gf.way = cs.way AND gf.formed_pos BETWEEN sweep_pos + 2 AND end_pos
  QUALIFY row_number() OVER (PARTITION BY cs.symbol, c, formed_pos, cs.way ORDER BY sweep_pos, level_pos) = 1)"""
_LAST = "SELECT symbol, c, kind, arg_max(price, lp) AS price FROM (SELECT b.symbol, b.pos AS c, lv.kind, lv.pos AS lp, lv.price FROM x b JOIN lv ON lv.symbol = b.symbol AND lv.kf <= b.pos AND lv.kt > b.pos) GROUP BY ALL"


@query("d26_market_states", f"""{_KNOWN}, r AS ({_LAST}), k AS (SELECT b.symbol, b.pos, b.close,
  (SELECT count(*) FROM pool p WHERE p.symbol = b.symbol AND p.pos + 2 <= b.pos AND (hit_pos IS NULL OR hit_pos > b.pos)) AS n_pools, (SELECT count(*) FROM pool p WHERE p.symbol = b.symbol AND swept AND hit_pos <= b.pos) AS n_sweeps,
  (SELECT count(*) FROM mk WHERE mk.symbol = b.symbol AND mk.c = b.pos) AS n_displacements, coalesce(ns.n, 0) AS n_shifts, coalesce(ng.n, 0) AS n_gaps, h.price AS range_high, l.price AS range_low
  FROM x b LEFT JOIN (SELECT symbol, c, count(*) AS n FROM cs GROUP BY ALL) ns ON ns.symbol = b.symbol AND ns.c = b.pos LEFT JOIN (SELECT symbol, c, count(*) AS n FROM go GROUP BY ALL) ng ON ng.symbol = b.symbol AND ng.c = b.pos
  LEFT JOIN r h ON h.symbol = b.symbol AND h.c = b.pos AND h.kind = 1 LEFT JOIN r l ON l.symbol = b.symbol AND l.c = b.pos AND l.kind = -1)
SELECT *  EXCLUDE (close), CASE WHEN close > (range_high + range_low) / 2 THEN 'premium' WHEN close < (range_high + range_low) / 2 THEN 'discount' WHEN range_high + range_low IS NOT NULL THEN 'equilibrium' END AS zone FROM k""")
def _(spark, d):
    middle = (F.col("range_high") + F.col("range_low")) / 2
    zone = F.when(F.col("close") > middle, "premium").when(F.col("close") < middle, "discount").when(middle.isNotNull(), "equilibrium")
    return Known(placed(spark, d)).states().withColumn("zone", zone).drop("close")


_LIVE = f"""{_KNOWN}, gx AS (SELECT g.symbol, g.formed_pos, g.way, min(b.pos) FILTER (WHERE CASE WHEN g.way = 1 THEN b.low <= (top + bottom) / 2 ELSE b.high >= (top + bottom) / 2 END) AS tp, min(b.pos) FILTER (WHERE CASE WHEN g.way = 1 THEN b.close < bottom ELSE b.close > top END) AS mp
  FROM gf g JOIN x b ON b.symbol = g.symbol AND b.pos > g.formed_pos GROUP BY ALL),
li0 AS (SELECT go.*, extreme AS stop, abs(extreme - entry) AS risk, CASE WHEN tp <= c THEN 'touched' ELSE 'unfilled' END AS status FROM go LEFT JOIN gx USING (symbol, formed_pos, way) WHERE mp IS NULL OR mp > c),
tg AS (SELECT l.symbol, l.c, l.formed_pos, l.way, coalesce(min(p.price) FILTER (WHERE l.way = 1), max(p.price) FILTER (WHERE l.way = -1)) AS target FROM li0 l JOIN pool p ON p.symbol = l.symbol AND p.kind = l.way AND p.pos + 2 <= l.c AND (p.hit_pos IS NULL OR p.hit_pos > l.c) AND CASE WHEN l.way = 1 THEN p.price > entry ELSE p.price < entry END GROUP BY ALL),
li1 AS (SELECT li0.*, target, CASE WHEN risk > 0 THEN round(coalesce(abs(entry - target), 0) / risk, 2) ELSE 0 END AS rr FROM li0 LEFT JOIN tg USING (symbol, c, formed_pos, way)),
li2 AS (SELECT *, CASE WHEN (way = -1 AND entry >= stop) OR (way = 1 AND entry <= stop) THEN 'entry beyond the extreme' WHEN target IS NULL THEN 'no target' WHEN rr < 3.0 THEN 'reward too small' ELSE '' END AS reject FROM li1),
nw AS (SELECT symbol, c, -way AS way, max(placed) AS newest FROM ct GROUP BY ALL),
li AS (SELECT l.*, CASE WHEN coalesce(newest > ct.placed, false) OR coalesce({_DAY.format('s.et')} <> {_DAY.format('b.et')}, false) THEN 'historical' WHEN reject = '' THEN 'current' ELSE 'active' END AS life
  FROM li2 l JOIN ct ON ct.symbol = l.symbol AND ct.c = l.c AND ct.level_pos = l.level_pos AND ct.way = l.way LEFT JOIN nw ON nw.symbol = l.symbol AND nw.c = l.c AND nw.way = l.way
  JOIN x b ON b.symbol = l.symbol AND b.pos = l.c JOIN x s ON s.symbol = l.symbol AND s.pos = l.sweep_pos)"""


@query("d31_decision_records", f"""{_LIVE}, bs AS (SELECT symbol, c, formed_pos, way, entry, stop, target, rr FROM li WHERE life = 'current' QUALIFY row_number() OVER (PARTITION BY symbol, c ORDER BY rr DESC, round(risk, 2), formed_pos, way) = 1)
SELECT x.symbol, x.pos, coalesce(n.n_live, 0) AS n_live, coalesce(n.n_actionable, 0) AS n_actionable, coalesce(n.n_current, 0) AS n_current, formed_pos, CASE way WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'NO-TRADE' END AS decision, round(entry, 6) AS entry, stop, target, rr
FROM x LEFT JOIN (SELECT symbol, c, count(*) AS n_live, count(*) FILTER (WHERE reject = '') AS n_actionable, count(*) FILTER (WHERE life = 'current') AS n_current FROM li GROUP BY ALL) n ON n.symbol = x.symbol AND n.c = x.pos LEFT JOIN bs ON bs.symbol = x.symbol AND bs.c = x.pos""")
def _(spark, d):
    out = Known(placed(spark, d)).decisions()
    return out.select("symbol", "pos", "n_live", "n_actionable", "n_current", "formed_pos", "decision", r6("entry", "entry"), "stop", "target", "rr")


_C = "greatest(0.0, least(1.0, {0}))"
_TICKETS = f"""{_LIVE}, r AS ({_LAST}), bs AS (SELECT symbol, c, way, entry, stop, target, rr FROM li WHERE life = 'current' QUALIFY row_number() OVER (PARTITION BY symbol, c ORDER BY rr DESC, round(risk, 2), formed_pos, way) = 1),
t0 AS (SELECT x.symbol, x.pos, x.ts, way, entry, stop, target, rr, h.price AS rh, l.price AS rl, (h.price + l.price) / 2 AS ce FROM x LEFT JOIN bs ON bs.symbol = x.symbol AND bs.c = x.pos LEFT JOIN r h ON h.symbol = x.symbol AND h.c = x.pos AND h.kind = 1 LEFT JOIN r l ON l.symbol = x.symbol AND l.c = x.pos AND l.kind = -1),
t1 AS (SELECT *, CASE WHEN way IS NOT NULL AND ce IS NOT NULL THEN round({_C.format("CASE WHEN way = 1 THEN (ce - entry) / CASE WHEN ce <> rl THEN ce - rl ELSE 1e-9 END ELSE (entry - ce) / CASE WHEN rh <> ce THEN rh - ce ELSE 1e-9 END END")}, 4) END AS pd,
  CASE WHEN way IS NOT NULL AND ce IS NOT NULL THEN round({_C.format("1 - abs(entry - ce) / (0.5 * CASE WHEN rh <> rl THEN rh - rl ELSE 1e-9 END)")}, 4) END AS cd FROM t0), t2 AS (SELECT *, round(0.6 * pd + 0.4 * cd, 4) AS q FROM t1)"""


@query("r07_tickets", f"""{_TICKETS} SELECT symbol, pos, symbol || ':60m:' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ticket, CASE way WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'NO-TRADE' END AS decision, CASE WHEN way IS NULL THEN 'NO_SETUP' WHEN q >= 0.39 THEN 'TAKE' ELSE 'SKIP' END AS action, CASE WHEN q >= 0.39 THEN 'TRADE' WHEN q < 0.39 THEN 'PASS' ELSE 'N/A' END AS execution,
  coalesce(q, 0) AS confidence, CASE WHEN pd <= cd THEN 'pd_location' WHEN pd > cd THEN 'ce_distance' ELSE '' END AS weakest, CASE WHEN pd <= cd THEN concat_ws(',', CASE WHEN pd < 0.5 THEN 'pd_location' END, CASE WHEN cd < 0.5 THEN 'ce_distance' END) WHEN pd > cd THEN concat_ws(',', CASE WHEN cd < 0.5 THEN 'ce_distance' END, CASE WHEN pd < 0.5 THEN 'pd_location' END) ELSE '' END AS issues,
  round(entry, 6) AS entry, stop, round(abs(entry - stop), 4) AS risk, round(entry + way * 2.0 * abs(entry - stop), 4) AS exit_target, target, rr FROM t2""")
def _(spark, d):
    return Known(placed(spark, d)).tickets("60m").withColumn("entry", F.round("entry", 6))


@query("d29_setup_records", f"{_LIVE} SELECT symbol, c AS pos, formed_pos, way, sweep_pos, c - formed_pos AS age, status, round(entry, 6) AS entry, round(risk, 6) AS risk, target, rr, reject, life AS state FROM li")
def _(spark, d):
    known = Known(placed(spark, d))
    rows = known.lifecycle(known.live_setups())
    return rows.select("symbol", "pos", "formed_pos", "way", "sweep_pos", (F.col("pos") - F.col("formed_pos")).alias("age"), "status", r6("entry", "entry"), r6("risk", "risk"), "target", "rr", "reject", "state")


_STALL = f"""{_LIVE}, ta0 AS (SELECT symbol, formed_pos, way, c AS k, entry, stop, risk, rr, sweep_pos, level_pos FROM li WHERE reject = '' QUALIFY row_number() OVER (PARTITION BY symbol, formed_pos, way ORDER BY c) = 1),
ta AS (SELECT t.*, CASE WHEN t.way = 1 THEN e.high ELSE e.low END AS dend FROM ta0 t JOIN mk ON mk.symbol = t.symbol AND mk.c = k AND mk.level_pos = t.level_pos AND mk.way = t.way JOIN x e ON e.symbol = t.symbol AND e.pos = mk.end_pos),
sw AS (SELECT t.symbol, t.formed_pos, t.way, min(t.way * (lv.price - entry)) AS ahead FROM ta t JOIN lv ON lv.symbol = t.symbol AND lv.kind = t.way AND lv.kf <= k AND lv.kt > k AND t.way * (lv.price - entry) > 0 GROUP BY ALL),
rg0 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS sp FROM x), rg AS (SELECT symbol, pos, avg(sp) OVER (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING) AS mean_range FROM rg0),
fi AS (SELECT t.symbol, t.formed_pos, t.way, min(b.pos) AS fill FROM ta t JOIN x b ON b.symbol = t.symbol AND b.pos BETWEEN k AND k + 96 AND b.low <= entry AND b.high >= entry GROUP BY ALL),
pa AS (SELECT t.symbol, t.formed_pos, t.way, fill, b.pos, CASE WHEN t.way = 1 THEN b.high - entry ELSE entry - b.low END AS gain, CASE WHEN t.way = 1 THEN b.low - entry ELSE entry - b.high END AS dip FROM ta t JOIN fi USING (symbol, formed_pos, way) JOIN x b ON b.symbol = t.symbol AND b.pos BETWEEN fill AND fill + 96),
pb AS (SELECT *, greatest(0, coalesce(max(gain) OVER (PARTITION BY symbol, formed_pos, way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best0, max(pos) OVER (PARTITION BY symbol, formed_pos, way) AS ende FROM pa),
me AS (SELECT symbol, formed_pos, way, any_value(fill) AS fill, any_value(ende) AS ende, greatest(0, max(gain)) AS best, coalesce(max(pos) FILTER (WHERE gain > best0), any_value(fill)) AS best_bar, max(best0 - dip) FILTER (WHERE pos > fill) AS back FROM pb GROUP BY ALL),
mk2 AS (SELECT symbol, formed_pos, way, pos FROM pb WHERE gain > best0 OR pos = fill UNION SELECT symbol, formed_pos, way, ende FROM me), ls AS (SELECT symbol, formed_pos, way, coalesce(max(gap), 0) AS longest_stall FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY symbol, formed_pos, way ORDER BY pos) AS gap FROM mk2) GROUP BY ALL),
tu AS (SELECT m.symbol, m.formed_pos, m.way, max(CASE WHEN m.way = 1 THEN b.high - entry ELSE entry - b.low END) AS peak, max(CASE WHEN m.way = 1 THEN b.high - entry ELSE entry - b.low END) FILTER (WHERE b.pos > best_bar) AS after FROM me m JOIN ta USING (symbol, formed_pos, way) JOIN x b ON b.symbol = m.symbol AND b.pos BETWEEN best_bar - 2 AND best_bar + 2 GROUP BY ALL),
sr2 AS (SELECT t.symbol, t.formed_pos, t.way, k AS pos, fill, best_bar, longest_stall, round(best / risk, 3) AS mfe_r, round(rr, 3) AS reward_r, round(abs(dend - stop) / risk, 3) AS leg_r, round((entry - stop) / CASE WHEN dend <> stop THEN dend - stop END, 3) AS entry_share, round(t.way * (dend - entry) / risk, 3) AS to_leg_end_r,
  round(CASE WHEN t.way * (dend - entry) > 0 THEN best / (t.way * (dend - entry)) END, 3) AS mfe_to_leg_end, round(risk / CASE WHEN mean_range <> 0 THEN mean_range END, 3) AS risk_ranges, round(best / CASE WHEN mean_range <> 0 THEN mean_range END, 3) AS mfe_ranges, round(ahead / risk, 3) AS swing_r, round(back / risk, 3) AS retrace_r,
  CASE WHEN best_bar + 2 <= ende THEN best >= peak - 1e-9 AND after < best - 1e-9 END AS turned
  FROM ta t JOIN me USING (symbol, formed_pos, way) JOIN ls USING (symbol, formed_pos, way) JOIN tu USING (symbol, formed_pos, way) LEFT JOIN sw USING (symbol, formed_pos, way) JOIN rg ON rg.symbol = t.symbol AND rg.pos = k WHERE risk > 0)"""


@query("d35_stall_measures", f"{_STALL} SELECT * FROM sr2")
def _(spark, d):
    return stall.measures(Known(placed(spark, d)))


@query("g18_stall_report", f"""{_STALL} SELECT symbol, count(*) AS n, round(100 * avg(turned::INT)) AS turned_percent, round(avg(longest_stall), 6) AS mean_stall, count(*) FILTER (WHERE mfe_to_leg_end < 0.8) AS below_end, count(*) FILTER (WHERE mfe_to_leg_end BETWEEN 0.8 AND 1.2) AS at_end, count(*) FILTER (WHERE mfe_to_leg_end > 1.2) AS beyond_end FROM sr2 GROUP BY symbol""")
def _(spark, d):
    return stall.report(stall.measures(Known(placed(spark, d))))
