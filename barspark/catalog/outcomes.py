"""Outcomes of orders derived from hourly bars: labels, exit rules, diagnostics and reports on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import placed, r6, with_atr
from barspark.catalog.sql import ATR
from barspark.plans import outcomes as O

HORIZON = 24

_ORDERS = f"""{ATR}, od AS (SELECT symbol || ':' || pos AS id, symbol, pos + 1 AS decision, close > open AS is_long, (open + close) / 2 AS price, (open + close) / 2 - 1.5 * atr * CASE WHEN close > open THEN 1 ELSE -1 END AS stop,
  (open + close) / 2 + 3.0 * atr * CASE WHEN close > open THEN 1 ELSE -1 END AS target FROM z WHERE atr > 0 AND close <> open),
fl AS (SELECT od.*, CASE WHEN is_long THEN 1 ELSE -1 END AS sd, abs(price - stop) AS rk, min(b.pos) AS fill FROM od LEFT JOIN x b ON b.symbol = od.symbol AND b.pos BETWEEN decision AND decision + {HORIZON} AND b.low <= price AND b.high >= price GROUP BY ALL),
lf AS (SELECT fl.*, b.pos AS bp, b.close AS c, CASE WHEN is_long THEN b.high - price ELSE price - b.low END AS best, CASE WHEN is_long THEN price - b.low ELSE b.high - price END AS worst,
  CASE WHEN is_long THEN b.low <= stop ELSE b.high >= stop END AS hs, CASE WHEN is_long THEN b.high >= target ELSE b.low <= target END AS ht,
  CASE WHEN is_long THEN b.high >= price + rk ELSE b.low <= price - rk END AS h1, CASE WHEN is_long THEN b.high >= price + 2 * rk ELSE b.low <= price - 2 * rk END AS h2, CASE WHEN is_long THEN b.high >= price + 3 * rk ELSE b.low <= price - 3 * rk END AS h3,
  CASE WHEN is_long THEN b.low <= price ELSE b.high >= price END AS hb FROM fl JOIN x b ON b.symbol = fl.symbol AND b.pos BETWEEN fill AND fill + {HORIZON}),
pa AS (SELECT id, min(bp) FILTER (WHERE hs) AS sp, min(bp) FILTER (WHERE ht) AS tp, min(bp) FILTER (WHERE h1) AS p1, min(bp) FILTER (WHERE h2) AS p2, min(bp) FILTER (WHERE h3) AS p3, max(bp) AS "end", arg_max(c, bp) AS lc FROM lf GROUP BY id),
j AS (SELECT fl.*, pa.* EXCLUDE (id), coalesce(sp, 1e9) AS s, coalesce(tp, 1e9) AS t, round(sd * (lc - price) / rk, 3) + 0.0 AS mark, round(abs(target - price) / rk, 3) AS reward FROM fl LEFT JOIN pa USING (id)),
lb0 AS (SELECT *, CASE WHEN fill IS NULL THEN 'NO_FILL' WHEN s = 1e9 AND t = 1e9 THEN 'HORIZON' WHEN s = t THEN 'AMBIGUOUS' WHEN t < s THEN 'TARGET' ELSE 'STOP' END AS result, CASE WHEN fill IS NOT NULL THEN least(s, t, "end")::BIGINT END AS final FROM j),
ex AS (SELECT lf.id, max(best) AS mx, max(worst) AS wx, arg_min(bp, bp) FILTER (WHERE best = mb) AS mfe_pos FROM (SELECT lf.*, l.final, max(best) OVER (PARTITION BY lf.id) AS mb FROM lf JOIN lb0 l ON l.id = lf.id AND lf.bp <= l.final) lf GROUP BY lf.id),
lb AS (SELECT lb0.*, round(CASE result WHEN 'TARGET' THEN abs(target - price) / rk WHEN 'STOP' THEN -1 WHEN 'HORIZON' THEN sd * (lc - price) / rk END, 3) + 0.0 AS realized, round(mx / rk, 3) AS mfe, round(wx / rk, 3) AS mae, mfe_pos FROM lb0 LEFT JOIN ex USING (id))"""


def orders(spark, d):
    """An order at every bar's body middle, with the bar's direction, 1.5 ATR of risk and a target of two risks."""
    long = F.col("close") > F.col("open")
    way = F.when(long, 1).otherwise(-1)
    middle = (F.col("open") + F.col("close")) / 2
    frame = with_atr(spark, d).where("atr > 0 and close <> open")
    return frame.select(F.concat_ws(":", "symbol", "pos").alias("id"), "symbol", (F.col("pos") + 1).alias("decision"), long.alias("is_long"), middle.alias("price"), (middle - 1.5 * F.col("atr") * way).alias("stop"), (middle + 3.0 * F.col("atr") * way).alias("target"))


def labelled(spark, d):
    return O.labels(orders(spark, d), placed(spark, d), HORIZON)


_REACH = ", ".join(f"CASE WHEN fill IS NOT NULL THEN CASE WHEN {c} IS NULL OR s < {c} THEN 'no' WHEN s = {c} THEN 'ambiguous' ELSE 'yes' END END AS {n}" for n, c in (("before_stop", "tp"), ("r1", "p1"), ("r2", "p2"), ("r3", "p3")))


@query("d32_outcome_labels", f"{_ORDERS} SELECT id, symbol, result, fill, final, realized, mfe, mae, {_REACH} FROM lb")
def _(spark, d):
    return labelled(spark, d).select("id", "symbol", "result", "fill", "final", "realized", "mfe", "mae", "before_stop", "r1", "r2", "r3")


def _fixed(n: int) -> str:
    p = f"coalesce(p{n}, 1e9)"
    return f"CASE WHEN fill IS NULL THEN 'NO_FILL' WHEN {p} = 1e9 AND s = 1e9 THEN 'HORIZON' WHEN {p} = s THEN 'AMBIGUOUS' WHEN {p} < s THEN 'TARGET' ELSE 'STOP' END AS fixed_{n}, round(CASE WHEN fill IS NULL OR {p} = s AND s < 1e9 THEN NULL WHEN {p} = 1e9 AND s = 1e9 THEN mark WHEN {p} < s THEN {n} ELSE -1 END, 3) + 0.0 AS fixed_{n}_r"


def _two(name: str, n: int, gain: float, after: str) -> str:
    f, p = f"f{n}", f"coalesce(p{n}, 1e9)"
    b = f"coalesce(b{n}, 1e9)"
    share = 1 - gain / 2
    return f"""CASE WHEN fill IS NULL THEN 'NO_FILL' WHEN {f} = 1e9 THEN 'HORIZON' WHEN s = {f} AND ({p} = {f} OR t = {f}) THEN 'AMBIGUOUS' WHEN t = {f} THEN 'TARGET' WHEN s = {f} THEN 'STOP' WHEN {b} = 1e9 AND t = 1e9 THEN '{after}HORIZON' WHEN {b} = t THEN 'AMBIGUOUS' WHEN t < {b} THEN '{after}TARGET' ELSE '{after}BE' END AS {name},
  round(CASE WHEN fill IS NULL THEN NULL WHEN {f} = 1e9 THEN mark WHEN s = {f} AND ({p} = {f} OR t = {f}) THEN NULL WHEN t = {f} THEN reward WHEN s = {f} THEN -1 WHEN {b} = 1e9 AND t = 1e9 THEN {gain} + {share} * mark WHEN {b} = t THEN NULL WHEN t < {b} THEN {gain} + {share} * reward ELSE {gain} END, 3) + 0.0 AS {name}_r"""


_MODELS = f"""{_ORDERS}, bk AS (SELECT lf.id, min(bp) FILTER (WHERE hb AND bp > p1) AS b1, min(bp) FILTER (WHERE hb AND bp > p2) AS b2 FROM lf JOIN pa USING (id) GROUP BY lf.id),
em0 AS (SELECT lb.*, b1, b2, least(s, t, coalesce(p1, 1e9)) AS f1, least(s, t, coalesce(p2, 1e9)) AS f2 FROM lb LEFT JOIN bk USING (id)),
em AS (SELECT id, symbol, {_fixed(2)}, {_fixed(3)}, result AS structural, realized AS structural_r, {_two('breakeven', 1, 0.0, '')}, {_two('runner', 2, 1.0, 'PARTIAL+')} FROM em0)"""
_RULES = ["fixed_2", "fixed_3", "structural", "breakeven", "runner"]


def modelled(spark, d):
    bars = placed(spark, d)
    return O.exit_models(O.labels(orders(spark, d), bars, HORIZON), bars)


@query("d33_five_exit_models", f"{_MODELS} SELECT * EXCLUDE (symbol) FROM em")
def _(spark, d):
    return modelled(spark, d).select("id", *(c for n in _RULES for c in (n, f"{n}_r")))


@query("g16_exit_model_report", f"""{_MODELS}, u AS (SELECT rule, r, res FROM em CROSS JOIN LATERAL (VALUES ('fixed_2', fixed_2_r, fixed_2), ('fixed_3', fixed_3_r, fixed_3), ('structural', structural_r, structural), ('breakeven', breakeven_r, breakeven), ('runner', runner_r, runner)) v(rule, r, res)),
k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY r DESC NULLS LAST) AS rn FROM u)
SELECT rule, count(*) AS n, count(r) AS scored, count(*) FILTER (WHERE r IS NULL) AS excluded, round(avg((r > 0)::INT) FILTER (WHERE r IS NOT NULL), 6) AS win_rate, round(avg(r), 6) AS expectancy, round(avg(least(r, 5)) FILTER (WHERE r IS NOT NULL), 6) AS capped, round(sum(r), 6) AS total, round(sum(r) FILTER (WHERE rn <= 5), 6) AS top5 FROM k GROUP BY rule""")
def _(spark, d):
    cells = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"{n}_r").alias("r")) for n in _RULES))
    rows = modelled(spark, d).select(F.explode(cells).alias("x")).select("x.*")
    best = F.slice(F.sort_array(F.collect_list("r"), asc=False), 1, 5)
    r = F.col("r")
    return rows.groupBy("rule").agg(
        F.count("*").alias("n"), F.count("r").alias("scored"), F.count_if(r.isNull()).alias("excluded"), r6(F.avg(F.when(r.isNotNull(), (r > 0).cast("int"))), "win_rate"), r6(F.avg("r"), "expectancy"),
        r6(F.avg(F.when(r.isNotNull(), F.least(r, F.lit(5.0)))), "capped"), r6(F.sum("r"), "total"), r6(F.aggregate(best, F.lit(0.0), lambda a, x: a + x), "top5"),
    )


@query("d34_exit_diagnostics", f'{_ORDERS} SELECT id, result, reward, mfe_pos - fill AS bars_to_mfe, CASE WHEN sp <= final THEN sp - fill END AS bars_to_stop, final - fill AS bars_to_final, tp - fill AS bars_to_target FROM lb WHERE fill IS NOT NULL')
def _(spark, d):
    rows = labelled(spark, d).where("fill is not null")
    since = lambda c: F.col(c) - F.col("fill")
    return rows.select("id", "result", F.round(F.abs(F.col("target") - F.col("price")) / O.risk(), 3).alias("reward"), since("mfe_pos").alias("bars_to_mfe"), F.when(F.col("stop_pos") <= F.col("final"), since("stop_pos")).alias("bars_to_stop"), since("final").alias("bars_to_final"), since("target_pos").alias("bars_to_target"))


_QUALITY = f"""{_ORDERS}, rc AS (SELECT lf.id, min(bp) FILTER (WHERE bp > sp AND h2) AS rp, max(best) FILTER (WHERE bp <= coalesce(sp, "end")) AS bm, max(best) FILTER (WHERE bp > sp) AS am FROM lf JOIN pa USING (id) GROUP BY lf.id),
sq AS (SELECT lb.id, lb.symbol, CASE WHEN sp IS NULL THEN 'survived' WHEN rp - sp <= 12 THEN 'premature_stop' WHEN rp IS NOT NULL THEN 'late_continuation' ELSE 'true_invalidation' END AS bucket, sp - fill AS bars_to_stop, round(greatest(0, bm / rk), 3) AS mfe_before_stop,
  CASE WHEN sp IS NOT NULL THEN coalesce(round(greatest(0, am / rk), 3), 0) END AS mfe_after_stop, rp - sp AS bars_to_recovery FROM lb JOIN rc USING (id))"""


@query("d36_stop_quality", f"{_QUALITY} SELECT * FROM sq")
def _(spark, d):
    return O.stop_quality(labelled(spark, d), placed(spark, d), HORIZON)


@query("g19_stop_buckets", f"{_QUALITY} SELECT symbol, bucket, count(*) AS n, round(avg(mfe_before_stop), 6) AS before, round(avg(mfe_after_stop), 6) AS after FROM sq GROUP BY symbol, bucket")
def _(spark, d):
    out = O.stop_quality(labelled(spark, d), placed(spark, d), HORIZON)
    return out.groupBy("symbol", "bucket").agg(F.count("*").alias("n"), r6(F.avg("mfe_before_stop"), "before"), r6(F.avg("mfe_after_stop"), "after"))


@query("j07_near_misses", f"""{_ORDERS}, nm AS (SELECT lb.id, any_value(lb.target) AS tg, any_value(lb.price) AS pr, max(CASE WHEN is_long THEN b.high - price ELSE price - b.low END) AS best FROM lb LEFT JOIN x b ON b.symbol = lb.symbol AND b.pos BETWEEN final + 1 AND final + {HORIZON} WHERE result = 'STOP' GROUP BY lb.id),
nn AS (SELECT id, coalesce(greatest(0, best) / abs(tg - pr), 0) AS share FROM nm) SELECT id, share >= 0.5 AS half, share >= 0.75 AS three_quarters, share >= 1 AS whole, round(share, 6) AS share FROM nn""")
def _(spark, d):
    return O.near_misses(labelled(spark, d), placed(spark, d), HORIZON)


@query("g12_record_aggregate", f"""{_ORDERS} SELECT symbol, count(*) AS n, count(fill) AS filled, count(realized) AS scored, count(*) FILTER (WHERE fill IS NULL) AS no_fill, count(*) FILTER (WHERE fill IS NOT NULL AND realized IS NULL) AS ambiguous, round(avg((realized > 0)::INT) FILTER (WHERE realized IS NOT NULL), 6) AS win_rate,
  round(avg(realized), 6) AS expectancy, round(sum(realized), 6) AS total, round(avg(mfe), 6) AS mfe, round(avg(mae), 6) AS mae FROM lb GROUP BY symbol""")
def _(spark, d):
    r = F.col("realized")
    return labelled(spark, d).groupBy("symbol").agg(
        F.count("*").alias("n"), F.count("fill").alias("filled"), F.count("realized").alias("scored"), F.count_if(F.col("fill").isNull()).alias("no_fill"), F.count_if(F.col("fill").isNotNull() & r.isNull()).alias("ambiguous"),
        r6(F.avg(F.when(r.isNotNull(), (r > 0).cast("int"))), "win_rate"), r6(F.avg("realized"), "expectancy"), r6(F.sum("realized"), "total"), r6(F.avg("mfe"), "mfe"), r6(F.avg("mae"), "mae"),
    )


@query("g14_closed_trades", f"""{_ORDERS}, q AS (SELECT symbol, id, final, fill, decision, realized AS r FROM lb WHERE realized IS NOT NULL), c AS (SELECT *, sum(r) OVER w AS cum, CASE WHEN sign(r) IS DISTINCT FROM lag(sign(r)) OVER o THEN 1 ELSE 0 END AS ch FROM q WINDOW o AS (PARTITION BY symbol ORDER BY final, decision), w AS (PARTITION BY symbol ORDER BY final, decision ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(cum) OVER w) AS peak, sum(ch) OVER w AS run FROM c WINDOW w AS (PARTITION BY symbol ORDER BY final, decision ROWS UNBOUNDED PRECEDING)), st AS (SELECT symbol, run, sign(any_value(r)) AS s, count(*) AS n FROM p GROUP BY symbol, run)
SELECT p.symbol, round(max(peak - cum), 6) AS drawdown, round(CASE WHEN sum(r) FILTER (WHERE r < 0) < 0 THEN coalesce(sum(r) FILTER (WHERE r > 0), 0) / -sum(r) FILTER (WHERE r < 0) END, 6) AS profit_factor, any_value(a.w) AS longest_wins, any_value(a.l) AS longest_losses, round(avg(final - fill), 6) AS hold_mean, quantile_cont(final - fill, 0.5) AS hold_median
FROM p JOIN (SELECT symbol, coalesce(max(n) FILTER (WHERE s > 0), 0) AS w, coalesce(max(n) FILTER (WHERE s < 0), 0) AS l FROM st GROUP BY symbol) a USING (symbol) GROUP BY p.symbol""")
def _(spark, d):
    rows = labelled(spark, d).where("realized is not null").withColumn("sign", F.signum("realized"))
    line = Window.partitionBy("symbol").orderBy("final", "decision")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum("realized").over(so_far)).withColumn("run", F.sum((~F.col("sign").eqNullSafe(F.lag("sign").over(line))).cast("int")).over(so_far))
    rows = rows.withColumn("fall", F.greatest(F.lit(0.0), F.max("cum").over(so_far)) - F.col("cum"))
    runs = rows.groupBy("symbol", "run", "sign").agg(F.count("*").alias("n")).groupBy("symbol").agg(*(F.coalesce(F.max(F.when(F.col("sign") == s, F.col("n"))), F.lit(0).cast("long")).alias(a) for a, s in (("longest_wins", 1), ("longest_losses", -1))))
    gain, loss = F.sum(F.when(F.col("realized") > 0, F.col("realized"))), -F.sum(F.when(F.col("realized") < 0, F.col("realized")))
    hold = F.col("final") - F.col("fill")
    out = rows.groupBy("symbol").agg(r6(F.max("fall"), "drawdown"), r6(F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss), "profit_factor"), r6(F.avg(hold), "hold_mean"), F.percentile(hold, F.lit(0.5)).alias("hold_median"))
    return out.join(runs, "symbol")


@query("g18_excursion_report", f"""{_ORDERS} SELECT symbol, round(quantile_cont(mfe, 0.5), 6) AS mfe_median, round(quantile_cont(mfe, 0.9), 6) AS mfe_p90, round(corr(mfe, mae), 6) AS correlation, round(avg((mfe >= 1)::INT), 6) AS reached_one, round(avg((mfe >= 2)::INT), 6) AS reached_two FROM lb WHERE fill IS NOT NULL GROUP BY symbol""")
def _(spark, d):
    rows = labelled(spark, d).where("fill is not null")
    share = lambda n, name: r6(F.avg((F.col("mfe") >= n).cast("int")), name)
    return rows.groupBy("symbol").agg(r6(F.percentile("mfe", F.lit(0.5)), "mfe_median"), r6(F.percentile("mfe", F.lit(0.9)), "mfe_p90"), r6(F.corr("mfe", "mae"), "correlation"), share(1, "reached_one"), share(2, "reached_two"))


@query("x23_supervised_targets", f"{_ORDERS} SELECT id, CASE result WHEN 'TARGET' THEN 1 WHEN 'STOP' THEN 0 END AS target_first, CASE WHEN fill IS NOT NULL THEN CASE WHEN p2 IS NULL OR s < p2 THEN 0 WHEN s = p2 THEN NULL ELSE 1 END END AS two_first FROM lb")
def _(spark, d):
    return labelled(spark, d).select("id", F.when(F.col("result") == "TARGET", 1).when(F.col("result") == "STOP", 0).alias("target_first"), F.when(F.col("r2") == "yes", 1).when(F.col("r2") == "no", 0).alias("two_first"))


@query("f22_clean_labels", f"{_ORDERS} SELECT symbol, count(*) AS n, round(avg((result = 'TARGET')::INT), 6) AS positive FROM lb WHERE result IN ('TARGET', 'STOP') GROUP BY symbol")
def _(spark, d):
    return labelled(spark, d).where(F.col("result").isin("TARGET", "STOP")).groupBy("symbol").agg(F.count("*").alias("n"), r6(F.avg((F.col("result") == "TARGET").cast("int")), "positive"))


@query("u08_label_sets", f"""{_ORDERS}, st AS (SELECT DISTINCT lb.symbol, result || ':' || hour(x.et) AS label, x.ts < TIMESTAMP '2024-01-20 00:00:00' AS dev FROM lb JOIN x ON x.symbol = lb.symbol AND x.pos = lb.decision - 1)
SELECT symbol, label, 'dev only' AS side FROM (SELECT symbol, label FROM st WHERE dev EXCEPT SELECT symbol, label FROM st WHERE NOT dev) UNION ALL SELECT symbol, label, 'holdout only' FROM (SELECT symbol, label FROM st WHERE NOT dev EXCEPT SELECT symbol, label FROM st WHERE dev)
UNION ALL SELECT symbol, label, 'both' FROM (SELECT symbol, label FROM st WHERE dev INTERSECT SELECT symbol, label FROM st WHERE NOT dev)""")
def _(spark, d):
    """Labels by hour of the day that only the development split has, only the holdout, or both."""
    from barspark.functions.session import eastern

    bars = placed(spark, d).select("symbol", (F.col("pos") + 1).alias("decision"), F.hour(eastern(F.col("ts"))).alias("hour"), (F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("dev"))
    rows = labelled(spark, d).join(bars, ["symbol", "decision"]).groupBy("symbol", F.concat_ws(":", "result", "hour").alias("label"))
    side = F.when(~F.bool_or("dev"), "holdout only").when(F.bool_and("dev"), "dev only").otherwise("both")
    return rows.agg(side.alias("side"))


#: Columns that tell how an order ended, which no feature may be.
OUTCOME_COLUMNS = {"result", "realized", "final", "fill", "mfe", "mae", "mark", "r1", "r2", "r3", "before_stop", "stop_pos", "target_pos"}


def check_features(frame, features: list[str]):
    """The frame's features; an outcome among them is an error."""
    leaks = OUTCOME_COLUMNS & set(features)
    if leaks:
        raise ValueError(f"features that tell the outcome: {sorted(leaks)}")
    return frame.select(*features)


@query("d40_candidate_dataset", f"""{_ORDERS}, e AS (SELECT lb.id, lb.symbol, lb.is_long, hour(x.et) AS hour_et, round(rk / lb.price, 6) AS risk_share, CASE result WHEN 'TARGET' THEN 1 ELSE 0 END AS label, lb."end" AS e, lb.fill, x.ts < TIMESTAMP '2024-01-20 00:00:00' AS dev, (SELECT min(b.pos) FROM x b WHERE b.symbol = lb.symbol AND b.ts >= TIMESTAMP '2024-01-20 00:00:00') AS cut
  FROM lb JOIN x ON x.symbol = lb.symbol AND x.pos = lb.decision - 1 WHERE result IN ('TARGET', 'STOP'))
SELECT id, symbol, is_long, hour_et, risk_share, label, CASE WHEN dev THEN 'dev' ELSE 'holdout' END AS split FROM e WHERE NOT dev OR cut IS NULL OR e < cut""")
def _(spark, d):
    from barspark.functions.session import eastern

    bars = placed(spark, d)
    cut = bars.where("ts >= timestamp_ntz'2024-01-20 00:00:00'").groupBy("symbol").agg(F.min("pos").alias("cut"))
    bp = bars.select("symbol", (F.col("pos") + 1).alias("decision"), F.hour(eastern(F.col("ts"))).cast("long").alias("hour_et"), (F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("dev"))
    rows = labelled(spark, d).where(F.col("result").isin("TARGET", "STOP")).join(bp, ["symbol", "decision"]).join(cut, "symbol", "left")
    # a development row's life must end before the holdout begins
    rows = rows.where(~F.col("dev") | F.col("cut").isNull() | (F.col("end") < F.col("cut")))
    rows = rows.withColumn("label", (F.col("result") == "TARGET").cast("int")).withColumn("split", F.when(F.col("dev"), "dev").otherwise("holdout")).withColumn("risk_share", r6(O.risk() / F.col("price")))
    return check_features(rows, ["id", "symbol", "is_long", "hour_et", "risk_share", "label", "split"])
