"""Setups and what they are made of, over hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import ORACLES, query
from barspark.catalog.bars import _SESSION, _SWING, hourly, placed, r6, secs, swings, ticks
from barspark.catalog.signals import _PIVOTS
from barspark.catalog.sql import POS, _bars
from barspark.functions import session as T
from barspark.operators import bars as B
from barspark.operators import structure as D
from barspark.operators import windows as V
from barspark.plans import setups as P
from barspark.sources.shared import written

_CHAIN = f"""{_PIVOTS}, hit AS (SELECT p.symbol, p.pos, p.kind, min(b.pos) AS hit_pos, arg_min(b.close, b.pos) AS hit_close, arg_min(CASE WHEN p.kind = 1 THEN b.high ELSE b.low END, b.pos) AS extreme
  FROM pv p JOIN x b ON b.symbol = p.symbol AND b.pos > p.pos + 2 AND CASE WHEN p.kind = 1 THEN b.high > p.price ELSE b.low < p.price END GROUP BY ALL),
pool AS (SELECT pv.*, hit_pos, hit_close, extreme, coalesce(CASE WHEN pv.kind = 1 THEN hit_close < price ELSE hit_close > price END, false) AS swept FROM pv LEFT JOIN hit USING (symbol, pos, kind)),
f1 AS (SELECT *, count(*) OVER a = 1 AND count(*) OVER b = 1 AND high > max(high) OVER b AND high >= max(high) OVER a AS top, count(*) OVER a = 1 AND count(*) OVER b = 1 AND low < min(low) OVER b AND low <= min(low) OVER a AS bottom
  FROM x WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
p1 AS (SELECT symbol, pos, 1 AS kind, high AS price FROM f1 WHERE top UNION ALL SELECT symbol, pos, -1, low FROM f1 WHERE bottom),
mv0 AS (SELECT q.symbol, q.pos AS level_pos, -q.kind AS way, any_value(q.price) AS price, any_value(q.extreme) AS extreme, any_value(q.hit_pos) AS sweep_pos, min(v.pos) AS turn_pos FROM pool q LEFT JOIN p1 v ON v.symbol = q.symbol AND v.kind = -q.kind AND v.pos > q.hit_pos WHERE q.swept GROUP BY q.symbol, q.pos, q.kind),
mv1 AS (SELECT *, coalesce(turn_pos, (SELECT max(pos) FROM x WHERE x.symbol = mv0.symbol)) AS end_pos, turn_pos IS NOT NULL AS exhausted FROM mv0),
mv AS (SELECT m.symbol, level_pos, way, price, extreme, sweep_pos, end_pos, exhausted FROM mv1 m JOIN x e ON e.symbol = m.symbol AND e.pos = end_pos WHERE end_pos > sweep_pos AND CASE WHEN way = 1 THEN e.high > extreme ELSE e.low < extreme END),
sm AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER o THEN 1 ELSE 0 END AS ch FROM pv WINDOW o AS (PARTITION BY symbol ORDER BY pos, kind)),
sr AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS run FROM sm),
sk AS (SELECT symbol, run, kind, first(pos ORDER BY kind * price DESC, pos) AS pos, first(price ORDER BY kind * price DESC, pos) AS price FROM sr GROUP BY ALL),
mb AS (SELECT mv.symbol, mv.level_pos, mv.way, max(sk.pos) AS broken_pos, arg_max(sk.price, sk.pos) AS broken_price FROM mv JOIN sk ON sk.symbol = mv.symbol AND sk.kind = mv.way AND sk.pos < mv.sweep_pos GROUP BY ALL),
ms0 AS (SELECT mv.*, broken_pos, broken_price FROM mv JOIN mb USING (symbol, level_pos, way)),
mc AS (SELECT m.symbol, m.level_pos, m.way, min(b.pos) FILTER (WHERE CASE WHEN m.way = 1 THEN b.close > broken_price ELSE b.close < broken_price END) AS confirm_pos, arg_min(b.close, b.pos) FILTER (WHERE CASE WHEN m.way = 1 THEN b.close > broken_price ELSE b.close < broken_price END) AS cc,
  min(b.pos) FILTER (WHERE CASE WHEN m.way = 1 THEN b.high > broken_price ELSE b.low < broken_price END) AS wick_pos FROM ms0 m JOIN x b ON b.symbol = m.symbol AND b.pos > m.sweep_pos GROUP BY ALL),
ms AS (SELECT ms0.*, confirm_pos, CASE WHEN confirm_pos IS NOT NULL THEN 'confirmed' WHEN wick_pos IS NOT NULL THEN 'candidate' ELSE 'potential' END AS state, coalesce(abs(broken_price - cc), 0) AS acceptance FROM ms0 LEFT JOIN mc USING (symbol, level_pos, way)),
gg AS (SELECT *, lag(high, 2) OVER w AS h0, lag(low, 2) OVER w AS l0 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
gf AS (SELECT symbol, pos AS formed_pos, CASE WHEN low > h0 THEN 1 ELSE -1 END AS way, CASE WHEN low > h0 THEN h0 ELSE high END AS bottom, CASE WHEN low > h0 THEN low ELSE l0 END AS top FROM gg WHERE low > h0 OR high < l0),
fv0 AS (SELECT ms.*, formed_pos, bottom, top, (top + bottom) / 2 AS middle FROM ms JOIN gf ON gf.symbol = ms.symbol AND gf.way = ms.way AND gf.formed_pos BETWEEN ms.sweep_pos + 2 AND ms.end_pos QUALIFY row_number() OVER (PARTITION BY ms.symbol, formed_pos, ms.way ORDER BY sweep_pos, level_pos) = 1),
ft AS (SELECT f.symbol, f.formed_pos, f.way, min(b.pos) FILTER (WHERE CASE WHEN f.way = 1 THEN b.low <= middle ELSE b.high >= middle END) AS tp, min(b.pos) FILTER (WHERE CASE WHEN f.way = 1 THEN b.close < bottom ELSE b.close > top END) AS mitigated_pos FROM fv0 f JOIN x b ON b.symbol = f.symbol AND b.pos > f.formed_pos GROUP BY ALL),
fv1 AS (SELECT fv0.*, mitigated_pos, CASE WHEN mitigated_pos IS NULL OR tp <= mitigated_pos THEN tp END AS touch_pos FROM fv0 LEFT JOIN ft USING (symbol, formed_pos, way)),
fv AS (SELECT *, CASE WHEN mitigated_pos IS NOT NULL THEN 'mitigated' WHEN touch_pos IS NOT NULL THEN 'touched' ELSE 'unfilled' END AS status FROM fv1),
st0 AS (SELECT fv.*, middle AS entry, extreme AS stop, CASE WHEN way = 1 THEN (SELECT min(price) FROM pool WHERE pool.symbol = fv.symbol AND kind = 1 AND hit_pos IS NULL AND pool.price > middle) ELSE (SELECT max(price) FROM pool WHERE pool.symbol = fv.symbol AND kind = -1 AND hit_pos IS NULL AND pool.price < middle) END AS target FROM fv),
st1 AS (SELECT *, abs(stop - entry) AS risk, coalesce(abs(entry - target), 0) AS reward FROM st0), st2 AS (SELECT *, CASE WHEN risk > 0 THEN round(reward / risk, 2) ELSE 0 END AS rr FROM st1),
st AS (SELECT *, CASE WHEN status = 'mitigated' THEN 'gap mitigated' WHEN (way = -1 AND entry >= stop) OR (way = 1 AND entry <= stop) THEN 'entry beyond the extreme' WHEN target IS NULL THEN 'no target' WHEN rr < 3.0 THEN 'reward too small' ELSE '' END AS reject FROM st2)"""


@query("d18_shift_states", f"{_CHAIN} SELECT symbol, level_pos, way, sweep_pos, broken_pos, confirm_pos, state, round(acceptance, 6) AS acceptance FROM ms")
def _(spark, d):
    return P.shifts(placed(spark, d)).select("symbol", "level_pos", "way", "sweep_pos", "broken_pos", "confirm_pos", "state", r6("acceptance", "acceptance"))


@query("d19_gap_states", f"{_CHAIN} SELECT symbol, formed_pos, way, sweep_pos, round(middle, 6) AS middle, touch_pos, mitigated_pos, status FROM fv")
def _(spark, d):
    bars = placed(spark, d)
    return P.imbalances(bars, P.shifts(bars)).select("symbol", "formed_pos", "way", "sweep_pos", r6("middle", "middle"), "touch_pos", "mitigated_pos", "status")


@query("d21_setups", f"{_CHAIN} SELECT symbol, formed_pos, way, round(entry, 6) AS entry, stop, target, rr, reject, reject = '' AS actionable FROM st")
def _(spark, d):
    return P.setups(placed(spark, d)).select("symbol", "formed_pos", "way", r6("entry", "entry"), "stop", "target", "rr", "reject", "actionable")


_FINE = _bars(15).replace("bars AS (", "fine AS (", 1)
_MSS = f"""{_CHAIN}, dm AS (SELECT symbol, kind AS way, pos AS broken_pos, (coalesce(kind * price > kind * lag(price) OVER k, true) AND coalesce(kind * price > kind * lead(price) OVER k, true))::INT AS dominant FROM sk WINDOW k AS (PARTITION BY symbol, kind ORDER BY pos)),
mr AS (SELECT ms.*, dominant, row_number() OVER (PARTITION BY ms.symbol ORDER BY CASE state WHEN 'confirmed' THEN 2 WHEN 'candidate' THEN 1 ELSE 0 END DESC, dominant DESC, acceptance DESC, broken_pos DESC, sweep_pos, level_pos) AS rank,
  count(*) OVER (PARTITION BY ms.symbol, state, dominant, acceptance, broken_pos) > 1 AS tied FROM ms JOIN dm USING (symbol, way, broken_pos))"""


@query("d25_ranked_shifts", f"{_MSS} SELECT symbol, level_pos, way, state, dominant, round(acceptance, 6) AS acceptance, broken_pos, rank, tied FROM mr")
def _(spark, d):
    bars = placed(spark, d)
    out = P.ranked_shifts(P.shifts(bars), bars)
    return out.select("symbol", "level_pos", "way", "state", F.col("f_dominant").alias("dominant"), r6("acceptance", "acceptance"), "broken_pos", F.col("rank").cast("long").alias("rank"), "tied")


_SWEEPS = f"""{_MSS}, dg AS (SELECT symbol, arg_max(price, pos) FILTER (WHERE kind = 1) AS rh, arg_max(price, pos) FILTER (WHERE kind = -1) AS rl FROM sk GROUP BY symbol), lx AS (SELECT symbol, arg_max(close, pos) AS lc FROM x GROUP BY symbol),
sf AS (SELECT q.symbol, q.pos, q.kind, hit_pos, price, extreme, rh, rl, lc, coalesce(dominant, 0) AS fd, coalesce((q.kind * price > q.kind * ((rh + rl) / 2))::INT, 0) AS fa, round(greatest(q.kind * (price - hit_close), 0.0) / (abs(extreme - price) + 1e-9), 3) AS fj
  FROM pool q LEFT JOIN dm ON dm.symbol = q.symbol AND dm.broken_pos = q.pos AND dm.way = q.kind LEFT JOIN dg ON dg.symbol = q.symbol JOIN lx ON lx.symbol = q.symbol WHERE swept),
so AS (SELECT *, row_number() OVER o AS rank, count(*) OVER (PARTITION BY symbol, fd, fa, fj, hit_pos) > 1 AS tied, count(*) OVER (PARTITION BY symbol) AS competing, lag(fd) OVER o AS ld, lag(fa) OVER o AS la, lag(fj) OVER o AS lj, lag(hit_pos) OVER o AS lh FROM sf WINDOW o AS (PARTITION BY symbol ORDER BY fd DESC, fa DESC, fj DESC, hit_pos DESC, pos, kind))"""


@query("d30_sweep_records", f"""{_SWEEPS} SELECT symbol, pos AS level_pos, hit_pos AS sweep_pos, -kind AS way, round(abs(extreme - price), 4) AS penetration, fd AS dominant, fa AS aligned, fj AS rejection, rank, tied, CASE WHEN rank = 1 THEN '' WHEN ld <> fd THEN 'dominant' WHEN la <> fa THEN 'aligned' WHEN lj <> fj THEN 'rejection' WHEN lh <> hit_pos THEN 'recency' ELSE 'tie' END AS lost_by, competing,
  CASE WHEN rh > rl THEN round((lc - rl) / (rh - rl), 4) END AS location, CASE WHEN rh > rl THEN CASE WHEN lc > (rh + rl) / 2 THEN 'premium' WHEN lc < (rh + rl) / 2 THEN 'discount' ELSE 'equilibrium' END END AS zone FROM so""")
def _(spark, d):
    out = P.sweep_records(written(placed(spark, d), "bars"))
    return out.select("symbol", "level_pos", "sweep_pos", "way", "penetration", F.col("f_dominant").alias("dominant"), F.col("f_aligned").alias("aligned"), F.col("f_rejection").alias("rejection"), F.col("rank").cast("long").alias("rank"), "tied", "lost_by", "competing", "location", "zone")


@query("d20_refined_gaps", f"""{_MSS}, {_FINE}, fq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM fine), fl AS (SELECT *, lag(high, 2) OVER w AS h0, lag(low, 2) OVER w AS l0, lag(ts, 2) OVER w AS start FROM fq WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
fg AS (SELECT symbol, pos AS formed_pos, start, CASE WHEN low > h0 THEN 1 ELSE -1 END AS way, CASE WHEN low > h0 THEN h0 ELSE high END AS bottom, CASE WHEN low > h0 THEN low ELSE l0 END AS top FROM fl WHERE low > h0 OR high < l0),
fo AS (SELECT g.symbol, g.formed_pos, g.way, any_value(g.bottom) AS bottom, any_value(g.top) AS top, any_value(g.top + g.bottom) / 2 AS middle, arg_min(m.sweep_pos, m.rank) AS sweep_pos, arg_min(m.level_pos, m.rank) AS level_pos, min(m.rank) AS rank
  FROM fg g JOIN mr m ON m.symbol = g.symbol AND m.way = g.way JOIN x s ON s.symbol = m.symbol AND s.pos = m.sweep_pos AND s.ts <= g.start GROUP BY g.symbol, g.formed_pos, g.way),
fs AS (SELECT f.symbol, f.formed_pos, f.way, min(b.pos) FILTER (WHERE CASE WHEN f.way = 1 THEN b.low <= middle ELSE b.high >= middle END) AS tp, min(b.pos) FILTER (WHERE CASE WHEN f.way = 1 THEN b.close < bottom ELSE b.close > top END) AS mp FROM fo f JOIN fq b ON b.symbol = f.symbol AND b.pos > f.formed_pos GROUP BY ALL)
SELECT symbol, formed_pos, way, sweep_pos, level_pos, rank, round(middle, 6) AS middle, CASE WHEN mp IS NULL OR tp <= mp THEN tp END AS touch_pos, mp AS mitigated_pos, CASE WHEN mp IS NOT NULL THEN 'mitigated' WHEN tp IS NOT NULL THEN 'touched' ELSE 'unfilled' END AS status FROM fo LEFT JOIN fs USING (symbol, formed_pos, way)""")
def _(spark, d):
    bars = written(placed(spark, d), "bars")
    fine = B.bars_of_ticks(ticks(spark, d), 15).withColumn("pos", V.position())
    out = P.refined_gaps(P.ranked_shifts(P.shifts(bars), bars), bars, fine)
    return out.select("symbol", F.col("formed_pos").cast("long").alias("formed_pos"), "way", "sweep_pos", "level_pos", F.col("rank").cast("long").alias("rank"), r6("middle", "middle"), "touch_pos", "mitigated_pos", "status")


_RANKED = f"""{_CHAIN}, rk AS (SELECT *, (reject = '')::INT AS fa, rr AS fr, -round(risk, 2) AS fk FROM st),
rn AS (SELECT *, row_number() OVER o AS rank, count(*) OVER (PARTITION BY symbol, fa, fr, fk) > 1 AS tied, lag(fa) OVER o AS la, lag(fr) OVER o AS lr, lag(fk) OVER o AS lk FROM rk WINDOW o AS (PARTITION BY symbol ORDER BY fa DESC, fr DESC, fk DESC, formed_pos, way))"""


@query("w33_ranked_setups", f"{_RANKED} SELECT symbol, formed_pos, way, rank, tied, CASE WHEN rank = 1 THEN '' WHEN la <> fa THEN 'actionable' WHEN lr <> fr THEN 'rr' WHEN lk <> fk THEN 'tight' ELSE 'tie' END AS lost_by FROM rn")
def _(spark, d):
    return P.ranked_setups(P.setups(placed(spark, d))).select("symbol", "formed_pos", "way", F.col("rank").cast("long").alias("rank"), "tied", "lost_by")


@query("d22_recommendation", f"""{_RANKED}, bs AS (SELECT symbol, arg_min(way, rank) AS way, arg_min(entry, rank) AS entry, arg_min(rr, rank) AS rr FROM rn WHERE reject = '' GROUP BY symbol)
SELECT s.symbol, CASE way WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'NO-TRADE' END AS decision, round(entry, 6) AS entry, rr FROM (SELECT DISTINCT symbol FROM x) s LEFT JOIN bs USING (symbol)""")
def _(spark, d):
    bars = placed(spark, d)
    return P.recommendations(P.ranked_setups(P.setups(bars)), bars).select("symbol", "decision", r6("entry", "entry"), "rr")


_DAY = "CASE WHEN hour({0}) = 17 OR isodow(CASE WHEN hour({0}) >= 18 THEN {0}::DATE + 1 ELSE {0}::DATE END) > 5 THEN NULL WHEN hour({0}) >= 18 THEN {0}::DATE + 1 ELSE {0}::DATE END"
_LIFE = f"""{_CHAIN}, lt AS (SELECT symbol, -way AS way, max(coalesce(confirm_pos, broken_pos)) AS against FROM ms GROUP BY ALL), nd AS (SELECT symbol, {_DAY.format('arg_max(et, pos)')} AS now_day FROM x GROUP BY symbol),
lc AS (SELECT st.*, CASE WHEN status = 'mitigated' THEN 'historical' WHEN coalesce(against > coalesce(confirm_pos, broken_pos), false) THEN 'historical' WHEN coalesce({_DAY.format('b.et')} <> now_day, false) THEN 'historical' WHEN reject = '' THEN 'current' ELSE 'active' END AS life
  FROM st LEFT JOIN lt ON lt.symbol = st.symbol AND lt.way = st.way JOIN x b ON b.symbol = st.symbol AND b.pos = st.sweep_pos JOIN nd ON nd.symbol = st.symbol)"""


@query("d23_lifecycle", f"{_LIFE} SELECT symbol, formed_pos, way, life AS state FROM lc")
def _(spark, d):
    bars = placed(spark, d)
    return P.lifecycle(P.setups(bars), bars).select("symbol", "formed_pos", "way", "state")


@query("g37_state_counts", f"{_LIFE} SELECT symbol, life AS state, status, count(*) AS n FROM lc GROUP BY ALL")
def _(spark, d):
    bars = placed(spark, d)
    return P.lifecycle(P.setups(bars), bars).groupBy("symbol", "state", "status").agg(F.count("*").alias("n"))


_EDGES = f"""{_LIFE}, ed AS (
  SELECT symbol, 'level:' || symbol || ':' || pos || ':' || kind AS child, 'swing:' || symbol || ':' || pos || ':' || kind AS parent FROM pool
  UNION SELECT symbol, 'sweep:' || symbol || ':' || pos || ':' || -kind, 'level:' || symbol || ':' || pos || ':' || kind FROM pool WHERE swept
  UNION SELECT symbol, 'move:' || symbol || ':' || level_pos || ':' || way, 'sweep:' || symbol || ':' || level_pos || ':' || way FROM mv
  UNION SELECT symbol, 'shift:' || symbol || ':' || level_pos || ':' || way, 'move:' || symbol || ':' || level_pos || ':' || way FROM ms
  UNION SELECT symbol, 'shift:' || symbol || ':' || level_pos || ':' || way, 'swing:' || symbol || ':' || broken_pos || ':' || way FROM ms
  UNION SELECT symbol, 'gap:' || symbol || ':' || formed_pos || ':' || way, k || symbol || ':' || level_pos || ':' || way FROM st, (VALUES ('move:'), ('shift:')) v(k)
  UNION SELECT symbol, 'setup:' || symbol || ':' || formed_pos || ':' || way, k || symbol || ':' || level_pos || ':' || way FROM st, (VALUES ('shift:'), ('sweep:')) v(k)
  UNION SELECT symbol, 'setup:' || symbol || ':' || formed_pos || ':' || way, 'gap:' || symbol || ':' || formed_pos || ':' || way FROM st
  UNION SELECT st.symbol, 'setup:' || st.symbol || ':' || formed_pos || ':' || way, 'level:' || st.symbol || ':' || pool.pos || ':' || pool.kind FROM st JOIN pool ON pool.symbol = st.symbol AND pool.kind = way AND pool.hit_pos IS NULL AND pool.price = target),
rc AS (SELECT life AS root, 'setup:' || symbol || ':' || formed_pos || ':' || way AS node FROM lc WHERE life IN ('current', 'active') UNION SELECT rc.root, ed.parent FROM rc JOIN ed ON ed.child = rc.node),
ob AS (SELECT symbol, child AS object FROM ed UNION SELECT symbol, parent FROM ed UNION SELECT symbol, 'swing:' || symbol || ':' || pos || ':' || kind FROM sk),
os AS (SELECT symbol, object, CASE WHEN object IN (SELECT node FROM rc WHERE root = 'current') THEN 'current' WHEN object IN (SELECT node FROM rc) THEN 'active' ELSE 'historical' END AS state FROM ob)"""


def chained(spark, d):
    """Bars, setups with their lifecycle and the dependencies, the latter two written once."""
    bars = written(placed(spark, d), "bars")
    lived = written(P.lifecycle(P.setups(bars), bars), "setups")
    return bars, lived, written(P.dependencies(bars, lived), "dependencies")


@query("d23_object_states", f"{_EDGES} SELECT symbol, object, state FROM os")
def _(spark, d):
    return P.object_states(*chained(spark, d))


@query("d23_object_counts", f"""{_EDGES}, oc AS (SELECT symbol, count(*) FILTER (WHERE state = 'current') AS current_objects, count(*) FILTER (WHERE state = 'active') AS active_objects, count(*) FILTER (WHERE state = 'historical') AS historical_objects FROM os GROUP BY symbol),
sc AS (SELECT symbol, count(*) FILTER (WHERE life = 'current') AS a, count(*) FILTER (WHERE life = 'active') AS b, count(*) FILTER (WHERE life = 'historical') AS c FROM lc GROUP BY symbol)
SELECT oc.*, coalesce(a, 0) AS current_setups, coalesce(b, 0) AS active_setups, coalesce(c, 0) AS historical_setups FROM oc LEFT JOIN sc USING (symbol)""")
def _(spark, d):
    bars, lived, edges = chained(spark, d)
    return P.state_counts(lived, P.object_states(bars, lived, edges))


@query("j15_dependency_lookup", f"""{_EDGES} SELECT symbol, child AS setup, min(parent) FILTER (WHERE parent LIKE 'gap:%') AS gap, min(parent) FILTER (WHERE parent LIKE 'shift:%') AS shift, min(parent) FILTER (WHERE parent LIKE 'sweep:%') AS sweep, count(*) FILTER (WHERE parent LIKE 'level:%') AS levels FROM ed WHERE child LIKE 'setup:%' GROUP BY symbol, child""")
def _(spark, d):
    return P.looked_up(chained(spark, d)[2])


_CLAMP = "greatest(0.0, least(1.0, {0}))"
_QUALITY = f"""{_CHAIN}, dr AS (SELECT symbol, arg_max(price, pos) FILTER (WHERE kind = 1) AS rh, arg_max(price, pos) FILTER (WHERE kind = -1) AS rl FROM sk GROUP BY symbol),
q0 AS (SELECT st.*, rh, rl, (rh + rl) / 2 AS ce, CASE WHEN rh <> rl THEN rh - rl ELSE 1e-9 END AS span FROM st JOIN dr USING (symbol)),
q1 AS (SELECT *, round({_CLAMP.format("CASE WHEN way = 1 THEN (ce - entry) / CASE WHEN ce <> rl THEN ce - rl ELSE 1e-9 END ELSE (entry - ce) / CASE WHEN rh <> ce THEN rh - ce ELSE 1e-9 END END")}, 4) AS pd_location, round({_CLAMP.format("1 - abs(entry - ce) / (0.5 * span)")}, 4) AS ce_distance,
  round(CASE WHEN rr BETWEEN 3 AND 8 THEN 1 WHEN rr > 8 THEN {_CLAMP.format("1 - (rr - 8) / 24")} ELSE {_CLAMP.format("rr / 3")} END, 4) AS rr_realism,
  round({_CLAMP.format("0.5 * CASE state WHEN 'confirmed' THEN 1.0 WHEN 'candidate' THEN 0.6 ELSE 0.2 END + CASE WHEN exhausted THEN 0.3 ELSE 0.15 END + 0.2 * " + _CLAMP.format("abs(extreme - price) / (0.25 * span)"))}, 4) AS confirmation,
  round({_CLAMP.format("0.7 * CASE status WHEN 'unfilled' THEN 1.0 WHEN 'touched' THEN 0.6 ELSE 0.0 END + 0.3 * " + _CLAMP.format("1 - abs((top - bottom) / span - 0.05) / 0.15"))}, 4) AS fvg_location FROM q0)"""


@query("x17_execution_quality", f"""{_QUALITY} SELECT symbol, formed_pos, way, pd_location, ce_distance, rr_realism, confirmation, fvg_location, round(0.6 * pd_location + 0.4 * ce_distance, 4) AS quality, CASE WHEN pd_location <= ce_distance THEN 'pd_location' ELSE 'ce_distance' END AS weakest,
  CASE WHEN round(0.6 * pd_location + 0.4 * ce_distance, 4) >= 0.39 THEN 'TRADE' ELSE 'PASS' END AS verdict FROM q1""")
def _(spark, d):
    bars = placed(spark, d)
    out = P.execution_quality(P.setups(bars), D.dealing_range(D.skeleton(D.pivots(bars))))
    return out.select("symbol", "formed_pos", "way", "pd_location", "ce_distance", "rr_realism", "confirmation", "fvg_location", "quality", "weakest", "verdict")


@query("d27_reasoning_graph", f"""{_CHAIN}, nd AS (SELECT 'setup:' || symbol || ':' || formed_pos || ':' || way AS child, 'gap:' || symbol || ':' || formed_pos || ':' || way AS parent FROM st UNION SELECT 'gap:' || symbol || ':' || formed_pos || ':' || way, 'shift:' || symbol || ':' || level_pos || ':' || way FROM st
  UNION SELECT 'shift:' || symbol || ':' || level_pos || ':' || way, 'sweep:' || symbol || ':' || level_pos || ':' || sweep_pos FROM st UNION SELECT 'sweep:' || symbol || ':' || level_pos || ':' || sweep_pos, 'level:' || symbol || ':' || level_pos FROM st)
SELECT child, parent FROM nd""")
def _(spark, d):
    found = P.setups(placed(spark, d))
    name = lambda kind, *c: F.concat_ws(":", F.lit(kind), *c)
    chain = [name("setup", "symbol", "formed_pos", "way"), name("gap", "symbol", "formed_pos", "way"), name("shift", "symbol", "level_pos", "way"), name("sweep", "symbol", "level_pos", "sweep_pos"), name("level", "symbol", "level_pos")]
    edges = F.array(*(F.struct(a.alias("child"), b.alias("parent")) for a, b in zip(chain, chain[1:])))
    return found.select(F.explode(edges).alias("e")).select("e.*").distinct()


@query("d44_fingerprints", f"""{_RANKED}, bs AS (SELECT symbol, arg_min(way, rank) AS way, arg_min(round(entry, 4), rank) AS entry, arg_min(stop, rank) AS stop FROM rn WHERE reject = '' GROUP BY symbol)
SELECT s.symbol, CASE way WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'NO-TRADE' END || '|' || coalesce((round(entry * 100))::BIGINT::VARCHAR, '') || '|' || coalesce((round(stop * 100))::BIGINT::VARCHAR, '') AS content,
  sha256(CASE way WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'NO-TRADE' END || '|' || coalesce((round(entry * 100))::BIGINT::VARCHAR, '') || '|' || coalesce((round(stop * 100))::BIGINT::VARCHAR, '')) AS fingerprint FROM (SELECT DISTINCT symbol FROM x) s LEFT JOIN bs USING (symbol)""")
def _(spark, d):
    bars = placed(spark, d)
    out = P.recommendations(P.ranked_setups(P.setups(bars)), bars)
    cents = lambda c: F.coalesce(F.round(c * 100).cast("long").cast("string"), F.lit(""))
    content = F.concat_ws("|", "decision", cents(F.round("entry", 4)), cents(F.col("stop")))
    return out.select("symbol", content.alias("content")).withColumn("fingerprint", F.sha2("content", 256))


@query("d13_liquidity_registry", f"""{_SESSION}, dd AS (SELECT symbol, sd AS day, max(high) AS h, min(low) AS l, row_number() OVER (PARTITION BY symbol ORDER BY sd DESC) AS rn FROM session GROUP BY symbol, sd),
ww AS (SELECT symbol, date_trunc('week', sd)::DATE AS day, max(high) AS h, min(low) AS l, row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('week', sd) DESC) AS rn FROM session GROUP BY symbol, date_trunc('week', sd)),
nm AS (SELECT symbol, ts, high, low, et::DATE AS day, hour(et) * 60 + minute(et) AS t, max(ts) OVER (PARTITION BY symbol) AS last_ts FROM x),
si AS (SELECT nm.*, v.name FROM nm JOIN (VALUES ('ASIA', 1080, 1440), ('LONDON', 120, 300), ('NY_AM', 510, 660), ('NY_PM', 810, 960)) v(name, a, b) ON t >= a AND t < b),
sg AS (SELECT symbol, name, day, max(high) AS h, min(low) AS l, max(ts) = any_value(last_ts) AS running FROM si GROUP BY symbol, name, day), sl AS (SELECT *, row_number() OVER (PARTITION BY symbol, name ORDER BY day DESC) AS rn FROM sg WHERE NOT running)
SELECT symbol, 'PD' AS name, day::VARCHAR AS period, h AS high, l AS low FROM dd WHERE rn = 2 UNION ALL SELECT symbol, 'PW', day::VARCHAR, h, l FROM ww WHERE rn = 2 UNION ALL SELECT symbol, name, day::VARCHAR, h, l FROM sl WHERE rn = 1""")
def _(spark, d):
    return D.liquidity_registry(hourly(spark, d)).select("symbol", "name", F.col("period").cast("string").alias("period"), "high", "low")


@query("d02_break_of_structure", f"{_SWING} SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN close > ch THEN 'bullish' WHEN close < cl THEN 'bearish' END AS bos FROM s WHERE close > ch OR close < cl")
def _(spark, d):
    bos = F.when(F.col("close") > F.col("ch"), "bullish").when(F.col("close") < F.col("cl"), "bearish")
    return swings(spark, d).withColumn("bos", bos).where("bos is not null").select("symbol", secs(), "bos")


_LEGS = f"""{_SWING}, pp AS (SELECT *, list({{'p': pos, 'v': high}}) FILTER (WHERE sh) OVER c AS hs, list({{'p': pos, 'v': low}}) FILTER (WHERE sl) OVER c AS ls FROM s WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
il AS (SELECT *, hs[-3:] AS h3, ls[-3:] AS l3 FROM pp)"""


@query("d03_impulse_legs", f"""{_LEGS} SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN len(list_filter(h3, lambda e: e.p > ls[-1].p)) > 0 THEN ls[-1].v END AS up_start, list_filter(h3, lambda e: e.p > ls[-1].p)[-1].v AS up_end,
  CASE WHEN len(list_filter(l3, lambda e: e.p > hs[-1].p)) > 0 THEN hs[-1].v END AS down_start, list_filter(l3, lambda e: e.p > hs[-1].p)[-1].v AS down_end FROM il""")
def _(spark, d):
    return D.impulse_legs(swings(spark, d)).select("symbol", secs(), "up_start", "up_end", "down_start", "down_end")


@query("d04_bias", f"""{_LEGS}, em AS (SELECT *, list_reduce(list(close) OVER u, lambda a, b: a + 2.0 / 10 * (b - a)) AS e9, list_reduce(list(close) OVER u, lambda a, b: a + 2.0 / 22 * (b - a)) AS e21, list_reduce(list(close) OVER u, lambda a, b: a + 2.0 / 51 * (b - a)) AS e50 FROM il WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
eb AS (SELECT *, CASE WHEN pos >= 59 THEN lag(e50, 10) OVER (PARTITION BY symbol ORDER BY ts) END AS before, CASE WHEN hs[-1].v > hs[-2].v AND ls[-1].v > ls[-2].v THEN 1 WHEN hs[-1].v < hs[-2].v AND ls[-1].v < ls[-2].v THEN -1 ELSE 0 END AS struct FROM em)
SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN before IS NULL THEN 'neutral' WHEN close > e50 AND e9 > e21 AND e21 > e50 AND e50 > before AND struct = 1 THEN 'bullish' WHEN close < e50 AND e9 < e21 AND e21 < e50 AND e50 < before AND struct = -1 THEN 'bearish' ELSE 'neutral' END AS bias FROM eb""")
def _(spark, d):
    frame = V.smoothed(swings(spark, d), {"fast": V.ema_spec("close", 9), "mid": V.ema_spec("close", 21), "slow": V.ema_spec("close", 50)})
    return frame.withColumn("bias", D.bias(10)).select("symbol", secs(), "bias")


@query("d15_ranges_by_timeframe")
def _(spark, d):
    base = hourly(spark, d)
    out = None
    for name, minutes in (("1h", 60), ("4h", 240)):
        bars = (base if minutes == 60 else B.resample(base, minutes)).withColumn("pos", V.position())
        part = D.dealing_range(D.skeleton(D.pivots(bars))).select("symbol", F.lit(name).alias("timeframe"), "range_high", "range_low", r6("equilibrium", "equilibrium"))
        out = part if out is None else out.unionByName(part)
    return out


def _range_sql(bars: str, name: str) -> str:
    tag = name.replace("h", "x")
    return f"""q{tag} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM {bars}), f{tag} AS (
  SELECT *, count(*) OVER a = 2 AND count(*) OVER b = 2 AND high > max(high) OVER b AND high >= max(high) OVER a AS top, count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER b AND low <= min(low) OVER a AS bottom
  FROM q{tag} WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
v{tag} AS (SELECT symbol, pos, 1 AS kind, high AS price FROM f{tag} WHERE top UNION ALL SELECT symbol, pos, -1, low FROM f{tag} WHERE bottom),
m{tag} AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER o THEN 1 ELSE 0 END AS ch FROM v{tag} WINDOW o AS (PARTITION BY symbol ORDER BY pos, kind)), r{tag} AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS run FROM m{tag}),
g{tag} AS (SELECT symbol, run, kind, first(pos ORDER BY kind * price DESC, pos) AS pos, first(price ORDER BY kind * price DESC, pos) AS price FROM r{tag} GROUP BY ALL),
e{tag} AS (SELECT symbol, '{name}' AS timeframe, arg_max(price, pos) FILTER (WHERE kind = 1) AS range_high, arg_max(price, pos) FILTER (WHERE kind = -1) AS range_low FROM g{tag} GROUP BY symbol)"""


ORACLES["d15_ranges_by_timeframe"] = f"""{POS}, four AS (SELECT symbol, floor(epoch(ts) / 14400) AS ts, max(high) AS high, min(low) AS low FROM bars GROUP BY symbol, floor(epoch(ts) / 14400)),
{_range_sql('bars', '1h')}, {_range_sql('four', '4h')}
SELECT *, round((range_high + range_low) / 2, 6) AS equilibrium FROM (SELECT * FROM e1x UNION ALL SELECT * FROM e4x)"""


@query("d10_session_exits", f"""{POS}, m AS (SELECT *, et::DATE AS day, hour(et) * 60 + minute(et) >= 955 AS flat FROM x) SELECT symbol, pos, coalesce(max(CASE WHEN flat THEN pos END) OVER w, max(pos) OVER w) AS exit_pos FROM m WINDOW w AS (PARTITION BY symbol, day)""")
def _(spark, d):
    local = T.eastern(F.col("ts"))
    day = Window.partitionBy("symbol", F.to_date(local))
    flat = T.minute_of_day(local) >= 955
    return placed(spark, d).select("symbol", F.col("pos").cast("long").alias("pos"), F.coalesce(F.max(F.when(flat, F.col("pos"))).over(day), F.max("pos").over(day)).cast("long").alias("exit_pos"))
