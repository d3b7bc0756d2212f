"""Evaluation of forecasts and models: tables by fold, decile, month and instrument, resampling, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import placed, r6, secs, with_atr
from barspark.catalog.models import _FOLD, _P, _Q1, _Q2, _RV, _steady, folded, logs, scored, steady
from barspark.catalog.outcomes import _ORDERS, labelled
from barspark.catalog.setups import _LIFE
from barspark.catalog.signals import _DAILY, _ROLLS, daily_orders
from barspark.catalog.sql import ATR, POS
from barspark.catalog.trades import _TR, trades
from barspark.functions import scalars as C
from barspark.functions import session as T
from barspark.operators import structure as D
from barspark.operators import windows as V
from barspark.plans import models as M
from barspark.plans import setups as U
from barspark.plans import simulation as P
from barspark.plans import resample as R
from barspark.plans import stats as S

_RET = f"""{_FOLD}, nx AS (SELECT symbol, pos, lead(close) OVER (PARTITION BY symbol ORDER BY pos) - close AS ret FROM x), fr AS (SELECT f.*, ret FROM f JOIN nx USING (symbol, pos)), fs AS (SELECT symbol, fold, min(i) AS fi FROM fr WHERE fold >= 0 GROUP BY ALL),
cm AS (SELECT fs.symbol, fs.fold, avg(ret) FILTER (WHERE y = 1) AS m1, avg(ret) FILTER (WHERE y = 0) AS m0, regr_slope(ret, p) AS b FROM fs JOIN fr ON fr.symbol = fs.symbol AND fr.i < fs.fi GROUP BY ALL)"""


def returns(spark, d):
    nxt = placed(spark, d).select("symbol", "pos", (F.lead("close").over(V.in_time()) - F.col("close")).alias("ret"))
    return folded(spark, d).join(nxt, ["symbol", "pos"])


def trained(spark, d):
    """Sums over the rows before each fold, from one aggregation by fold and a running total."""
    return M.before_folds(returns(spark, d), "symbol", "fold", {
        "n1": F.sum("y"), "s1": F.sum(F.col("ret") * F.col("y")), "n": F.count("*"), "s": F.sum("ret"), "sp": F.sum("p"), "spp": F.sum(F.col("p") * F.col("p")), "spr": F.sum(F.col("p") * F.col("ret")),
    })


def means(frame):
    n0 = F.col("n") - F.col("n1")
    return frame.withColumn("m1", F.when(F.col("n1") > 0, F.col("s1") / F.col("n1"))).withColumn("m0", F.when(n0 > 0, (F.col("s") - F.col("s1")) / n0))


@query("g21_class_means", f"{_RET} SELECT symbol, fold::INT AS fold, round(m1, 8) AS m1, round(m0, 8) AS m0 FROM cm")
def _(spark, d):
    return means(trained(spark, d)).select("symbol", "fold", F.round("m1", 8).alias("m1"), F.round("m0", 8).alias("m0"))


@query("st22_expected_values", f"""{_RET}, ev AS (SELECT fr.symbol, fr.pos, p, coalesce(m1, 0) AS a, coalesce(m0, 0) AS b, p * coalesce(m1, 0) + (1 - p) * coalesce(m0, 0) AS ev FROM fr JOIN cm USING (symbol, fold)) SELECT symbol, pos, round(ev, 6) AS ev, round(p * pow(a - ev, 2) + (1 - p) * pow(b - ev, 2), 6) AS variance FROM ev""")
def _(spark, d):
    rows = returns(spark, d).where("fold >= 0").select("symbol", "fold", "pos", "p").join(means(trained(spark, d)).select("symbol", "fold", "m1", "m0"), ["symbol", "fold"])
    p, a, b = F.col("p"), F.coalesce("m1", F.lit(0.0)), F.coalesce("m0", F.lit(0.0))
    rows = rows.withColumn("ev", p * a + (1 - p) * b)
    return rows.select("symbol", F.col("pos").cast("long").alias("pos"), r6("ev", "ev"), r6(p * F.pow(a - F.col("ev"), 2) + (1 - p) * F.pow(b - F.col("ev"), 2), "variance"))


@query("g24_coefficient_stability", f"""{_RET}, sg AS (SELECT symbol, sign(round(b, 9)) AS s, count(*) AS n FROM cm WHERE b IS NOT NULL GROUP BY ALL), mj AS (SELECT symbol, first(s ORDER BY n DESC, s) AS s, max(n) AS n, sum(n) AS total FROM sg GROUP BY symbol)
SELECT cm.symbol, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS spread, any_value(CASE WHEN mj.s <> 0 THEN round(mj.n / mj.total::DOUBLE, 6) END) AS consistency FROM cm JOIN mj USING (symbol) GROUP BY cm.symbol""")
def _(spark, d):
    n, sp, s = F.col("n"), F.col("sp"), F.col("s")
    spread = n * F.col("spp") - sp * sp
    slopes = trained(spark, d).withColumn("b", F.when(spread > 1e-12 * n * F.col("spp"), (n * F.col("spr") - sp * s) / spread)).where("b is not null")
    return S.sign_stability(slopes, "symbol", "b").select("symbol", r6("mean", "mean"), r6("spread", "spread"), r6("consistency", "consistency"))


_GAIN = "-ln(0.5) + ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15))"


@query("g25_bucketed_improvement", f"{_P} SELECT symbol, hour(et) AS bucket, count(*) AS n, round(avg({_GAIN}), 6) AS mean FROM pr GROUP BY symbol, hour(et) HAVING count(*) >= 5")
def _(spark, d):
    chosen = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    gain = C.neg_log_likelihood(F.lit(0.5)) - C.neg_log_likelihood(chosen)
    rows = scored(spark, d).withColumn("bucket", F.hour(T.eastern(F.col("ts"))).cast("long")).groupBy("symbol", "bucket").agg(F.count("*").alias("n"), r6(F.avg(gain), "mean"))
    return rows.where("n >= 5")


@query("g26_confidence_deciles", f"""{_P}, c AS (SELECT *, greatest(p, 1 - p) AS conf, ((p >= 0.5) = (y = 1))::INT AS hit FROM pr), e AS (SELECT symbol, quantile_cont(conf, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM c GROUP BY symbol), k AS (SELECT c.*, len(list_filter(edges, lambda v: v < conf)) AS cell FROM c JOIN e USING (symbol))
SELECT symbol, cell, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(hit), 6) AS accuracy FROM k GROUP BY symbol, cell""")
def _(spark, d):
    rows = scored(spark, d).withColumn("conf", F.greatest(F.col("p"), 1 - F.col("p"))).withColumn("hit", ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int"))
    return S.quantile_cells(rows, "conf", 10, "symbol").groupBy("symbol", F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("n"), r6(F.avg("conf"), "confidence"), r6(F.avg("hit"), "accuracy"))


@query("st19_decile_reliability", f"""{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, pos) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM pr), c AS (SELECT *, len(list_filter(range(1, 10), lambda k: 10 + (n - 1) * k < 10 * rn)) AS cell FROM r) SELECT symbol, cell, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM c GROUP BY symbol, cell""")
def _(spark, d):
    rows = scored(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("p", "pos"))).withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    cell = sum(((10 + (F.col("n_") - 1) * k < 10 * F.col("rn")).cast("long") for k in range(1, 10)), F.lit(0).cast("long"))
    return rows.withColumn("cell", cell).groupBy("symbol", "cell").agg(F.count("*").alias("n"), r6(F.avg("p"), "predicted"), r6(F.avg("y"), "observed"))


@query("g28_monthly_losses", f"{_RV} SELECT symbol, strftime(date_trunc('month', et), '%Y-%m') AS month, count(*) AS n, {_steady(_Q1, 'persistence')}, {_steady(_Q2, 'trailing')} FROM rv GROUP BY symbol, strftime(date_trunc('month', et), '%Y-%m')")
def _(spark, d):
    rows = logs(spark, d).withColumn("month", F.date_format(T.eastern(F.col("ts")), "yyyy-MM"))
    loss = lambda x, n: steady(F.avg(C.qlike(F.col("v"), F.exp(x))), n)
    return rows.groupBy("symbol", "month").agg(F.count("*").alias("n"), loss("x1", "persistence"), loss("x2", "trailing"))


@query("st16_incremental_r2", f"{_RV} SELECT symbol, round(1 - sum(pow(y - x2, 2)) / nullif(sum(pow(y - x1, 2)), 0), 6) AS gain FROM rv GROUP BY symbol")
def _(spark, d):
    error = lambda x: F.sum(F.pow(F.col("y") - F.col(x), 2))
    return logs(spark, d).groupBy("symbol").agg(r6(1 - F.try_divide(error("x2"), error("x1")), "gain"))


@query("ml22_gates", f"""{_RV}, a AS (SELECT symbol, count(*) AS n, 1 - {_Q2} / nullif({_Q1}, 0) AS reduction, regr_slope(y, x2) AS slope, regr_r2(y, x2) AS r2 FROM rv GROUP BY symbol) SELECT symbol, n, round(slope, 6) AS slope, round(r2, 6) AS r2, reduction >= 0.05 AS better, coalesce(slope BETWEEN 0.8 AND 1.2, false) AS unbiased, coalesce(n >= 30 AND reduction >= 0.05 AND slope BETWEEN 0.8 AND 1.2, false) AS go FROM a""")
def _(spark, d):
    loss = lambda x: F.avg(C.qlike(F.col("v"), F.exp(x)))
    rows = logs(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), (1 - F.try_divide(loss("x2"), loss("x1"))).alias("reduction"), F.regr_slope("y", "x2").alias("slope"), F.regr_r2("y", "x2").alias("r2"))
    better, unbiased = F.col("reduction") >= 0.05, F.col("slope").between(0.8, 1.2)
    return rows.select("symbol", "n", r6("slope", "slope"), r6("r2", "r2"), better.alias("better"), F.coalesce(unbiased, F.lit(False)).alias("unbiased"), F.coalesce((F.col("n") >= 30) & better & unbiased, F.lit(False)).alias("go"))


@query("ml04_horizons", f"""{POS}, h AS (SELECT symbol, pos, unnest([5, 10, 20]) AS horizon, close, pc FROM x), j AS (SELECT h.*, (b.close < h.close)::INT AS y, 1 / (1 + exp(-(h.close - h.pc) / 100)) AS p FROM h JOIN x b ON b.symbol = h.symbol AND b.pos = h.pos + h.horizon WHERE h.pc IS NOT NULL)
SELECT symbol, horizon, count(*) AS n, round(avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15))), 6) AS model, round(-(avg(y) * ln(greatest(avg(y), 1e-15)) + (1 - avg(y)) * ln(greatest(1 - avg(y), 1e-15))), 6) AS prior FROM j GROUP BY symbol, horizon""")
def _(spark, d):
    frame = placed(spark, d)
    ahead = [F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(V.in_time()).alias("then")) for h in (5, 10, 20)]
    rows = frame.withColumn("p", 1 / (1 + F.exp(-(F.col("close") - F.lag("close").over(V.in_time())) / 100))).withColumn("x", F.array(*ahead)).where("p is not null")
    rows = rows.select("symbol", "close", "p", F.explode("x").alias("x")).select("symbol", "close", "p", "x.*").where("then is not null").withColumn("y", (F.col("then") < F.col("close")).cast("int"))
    floor = lambda c: F.ln(F.greatest(c, F.lit(1e-15)))
    out = rows.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), r6(F.avg(-floor(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))), "model"), F.avg("y").alias("m"))
    return out.select("symbol", "horizon", "n", "model", r6(-(F.col("m") * floor(F.col("m")) + (1 - F.col("m")) * floor(1 - F.col("m"))), "prior"))


@query("ml03_aligned_classes", f"""{POS}, c AS (SELECT symbol, CASE WHEN close > open THEN 2 WHEN close < open THEN 0 ELSE 1 END AS k FROM x) SELECT symbol, count(*) FILTER (WHERE k = 0) AS c0, count(*) FILTER (WHERE k = 1) AS c1, count(*) FILTER (WHERE k = 2) AS c2, count(*) FILTER (WHERE k = 3) AS c3 FROM c GROUP BY symbol""")
def _(spark, d):
    frame = placed(spark, d).withColumn("k", F.when(F.col("close") > F.col("open"), 2).when(F.col("close") < F.col("open"), 0).otherwise(1))
    counts = frame.groupBy("symbol").pivot("k", [0, 1, 2, 3]).count()
    return counts.select("symbol", *(F.coalesce(F.col(str(k)), F.lit(0).cast("long")).alias(f"c{k}") for k in range(4)))


@query("ml20_forecast_streams")
def _(spark, d):
    test = M.ridge_walk_forward(logs(spark, d), ["x1", "x2"], "y", "v", "symbol", "pos")
    return test.select("symbol", secs(), "fold", r6(F.ln("forecast"), "log_forecast"), r6("x2", "log_baseline"))


@query("ml21_overlay_grid")
def _(spark, d):
    bars = with_atr(spark, d)
    marks = bars.withColumn("direction", F.when(F.col("close") != F.col("open"), F.signum(F.col("close") - F.col("open"))))
    out = None
    for j, m in enumerate((2.0, 4.0)):
        # a run is a symbol under one of the settings; distances carry the stop's multiple, so that runs of one target are one fold
        runs = marks.withColumn("g", F.explode(F.array(*(F.struct(F.lit(2 * i + j).alias("i"), F.lit(k).alias("k")) for i, k in enumerate((1.0, 2.0))))))
        runs = runs.select(F.concat_ws("|", "symbol", "g.i").alias("symbol"), "ts", "open", "high", "low", "close", (F.col("atr") * F.col("g.k")).alias("dist"), "direction")
        part = P.channel(runs, k=1.0, m=m, slip=0.05, distance="dist")
        out = part if out is None else out.unionByName(part)
    pnl = F.col("direction") * (F.col("exit") - F.col("entry"))
    return out.groupBy(F.split("symbol", r"\|")[0].alias("symbol"), F.split("symbol", r"\|")[1].alias("setting")).agg(F.count("*").alias("n"), r6(F.avg(pnl), "mean"), r6(F.sum(pnl), "total"))


@query("x09_class_directions", f"""{ATR}, f AS (SELECT symbol, ts, (lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - close) / CASE WHEN atr > 0 THEN atr END AS fr FROM z) SELECT symbol, epoch(ts)::BIGINT AS ts, sign((fr >= -1.5)::INT + (fr >= -0.5)::INT + (fr >= 0.5)::INT + (fr >= 1.5)::INT - 2)::INT AS direction FROM f WHERE fr IS NOT NULL""")
def _(spark, d):
    rows = with_atr(spark, d).withColumn("f", V.forward_return(5)).where("f is not null")
    return rows.select("symbol", secs(), C.class_direction(C.bucket(F.col("f"), [-1.5, -0.5, 0.5, 1.5]), 5).alias("direction"))


@query("x22_disagreements", f"""{POS}, s AS (SELECT symbol, ts, sign(close - open)::INT AS a, sign(close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts))::INT AS b FROM x) SELECT symbol, epoch(ts)::BIGINT AS ts, CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 'neither' WHEN coalesce(b, 0) = 0 THEN 'only_first' WHEN coalesce(a, 0) = 0 THEN 'only_second' WHEN a = b THEN 'agree' ELSE 'oppose' END AS category FROM s""")
def _(spark, d):
    b = F.signum(F.col("close") - F.lag("close", 5).over(V.in_time()))
    return placed(spark, d).select("symbol", secs(), C.disagreement(F.signum(F.col("close") - F.col("open")), b).alias("category"))


@query("g33_instrument_gates", f"""{_TR}, g AS (SELECT symbol, count(*) AS n, quantile_cont(abs(pnl) / 10, 0.5) AS med, quantile_cont(abs(pnl) / 10, 0.9) AS p90, avg(r) AS m FROM tr GROUP BY symbol) SELECT symbol, n, round(med, 6) AS slip_median, round(p90, 6) AS slip_p90, round(m, 6) AS mean_r, CASE WHEN n < 20 THEN 'INCONCLUSIVE' WHEN med <= 3 AND p90 <= 8 AND m > 0 THEN 'PASS' ELSE 'NO-GO' END AS verdict FROM g""")
def _(spark, d):
    slip = F.abs("pnl") / 10
    rows = trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.percentile(slip, F.lit(0.5)).alias("med"), F.percentile(slip, F.lit(0.9)).alias("p90"), F.avg("r").alias("m"))
    verdict = F.when(F.col("n") < 20, "INCONCLUSIVE").when((F.col("med") <= 3) & (F.col("p90") <= 8) & (F.col("m") > 0), "PASS").otherwise("NO-GO")
    return rows.select("symbol", "n", r6("med", "slip_median"), r6("p90", "slip_p90"), r6("m", "mean_r"), verdict.alias("verdict"))


@query("g09_equal_windows", f"{_TR}, s AS (SELECT symbol, min(entry) AS lo, max(entry) AS hi FROM tr GROUP BY symbol) SELECT symbol, t.w::INT AS w, round(lo + (hi - lo) * t.w / 6.0, 3) AS from_s, round(lo + (hi - lo) * (t.w + 1) / 6.0, 3) AS to_s FROM s CROSS JOIN range(6) t(w)")
def _(spark, d):
    span = trades(spark, d).groupBy("symbol").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi")).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(5))))
    edge = lambda w: F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * w / 6.0, 3)
    return span.select("symbol", "w", edge(F.col("w")).alias("from_s"), edge(F.col("w") + 1).alias("to_s"))


@query("st09_daily_r_sharpe", f"{_TR}, g AS (SELECT symbol, day, sum(r) AS r FROM tr GROUP BY ALL) SELECT symbol, round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END, 6) AS sharpe FROM g GROUP BY symbol")
def _(spark, d):
    by_day = trades(spark, d).groupBy("symbol", "day").agg(F.sum("r").alias("r"))
    return S.sharpe(by_day, "symbol", "r").select("symbol", r6("sharpe", "sharpe"))


@query("w30_cumulative_drawdown", f"{_TR}, c AS (SELECT *, sum(pnl) OVER w AS cum FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY entry ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, max(cum) OVER w AS pk FROM c WINDOW w AS (PARTITION BY symbol ORDER BY entry ROWS UNBOUNDED PRECEDING)) SELECT symbol, round(max(pk - cum), 6) AS drawdown FROM p GROUP BY symbol")
def _(spark, d):
    line = Window.partitionBy("symbol").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades(spark, d).withColumn("cum", F.sum("pnl").over(line)).withColumn("fall", F.max("cum").over(line) - F.col("cum"))
    return rows.groupBy("symbol").agg(r6(F.max("fall"), "drawdown"))


@query("st02_decile_spread_bootstrap")
def _(spark, d):
    rows = scored(spark, d).withColumn("conf", F.greatest(F.col("p"), 1 - F.col("p"))).withColumn("hit", ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))
    return R.bootstrap_spread(S.quantile_cells(rows, "conf", 10, "symbol"), "hit", "cell", "symbol")


@query("st03_block_bootstrap")
def _(spark, d):
    daily = trades(spark, d).groupBy("symbol", F.unix_date("day").alias("day")).agg(F.sum("r").alias("r"))
    return R.bootstrap_mean(daily, "r", "symbol", draws=2000, block=5, order="day", circular=False)


@query("st05_paired_sharpe_bootstrap")
def _(spark, d):
    rows = trades(spark, d).groupBy("symbol", F.unix_date("day").alias("day")).agg(F.sum(F.when(F.col("side") == "long", F.col("pnl")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("side") == "short", F.col("pnl")).otherwise(0.0)).alias("b"))
    return R.bootstrap_sharpe_difference(rows, "a", "b", "symbol", "day")


@query("st06_slippage_probability")
def _(spark, d):
    rows = trades(spark, d).withColumn("net", F.col("pnl") - 1.0)
    return R.bootstrap_mean(rows, "net", "symbol", order="entry").select("key", "n", "p")


@query("st11_deflated_best")
def _(spark, d):
    by_day = trades(spark, d).groupBy("symbol", "side", "day").agg(F.sum("pnl").alias("pnl"))
    return S.deflated_best(by_day, ["symbol", "side"], "pnl").select("symbol", "side", r6("sharpe", "sharpe"), r6("p", "p"))


@query("t05_largest_coefficients", f"""{_RV}, c AS (SELECT symbol, corr(y, x1) AS x1, corr(y, x2) AS x2, corr(y, slot) AS slot FROM rv GROUP BY symbol), u AS (SELECT symbol, v.name, v.w FROM c CROSS JOIN LATERAL (VALUES ('x1', x1), ('x2', x2), ('slot', slot)) v(name, w) WHERE v.w IS NOT NULL AND NOT isnan(v.w)) SELECT symbol, name, round(w, 6) AS weight FROM u ORDER BY round(abs(w), 9) DESC, symbol, name LIMIT 12""")
def _(spark, d):
    rows = logs(spark, d).groupBy("symbol").agg(F.array(*(F.struct(F.lit(c).alias("name"), F.corr("y", c).alias("w")) for c in ("x1", "x2", "slot"))).alias("u"))
    flat = rows.select("symbol", F.explode("u").alias("u")).select("symbol", "u.*").where("w is not null and not isnan(w)")
    return flat.orderBy(F.round(F.abs("w"), 9).desc(), "symbol", "name").limit(12).select("symbol", "name", r6("w", "weight"))


@query("d39_roll_metadata", f"""{_ROLLS}, s AS (SELECT dd.symbol, dd.day, count(r.day) OVER (PARTITION BY dd.symbol ORDER BY dd.day ROWS UNBOUNDED PRECEDING) AS segment FROM dd LEFT JOIN r ON r.symbol = dd.symbol AND r.day = dd.day) SELECT symbol, day::VARCHAR AS day, row_number() OVER (PARTITION BY symbol, segment ORDER BY day) - 1 AS since_roll, count(*) OVER (PARTITION BY symbol, segment) - row_number() OVER (PARTITION BY symbol, segment ORDER BY day) AS until_roll FROM s""")
def _(spark, d):
    daily = daily_orders(spark, d)
    return D.roll_metadata(D.segments(daily, D.rolls(daily))).select("symbol", F.col("day").cast("string").alias("day"), "since_roll", "until_roll")


@query("w34_current_ranks", f"{_LIFE} SELECT symbol, formed_pos, way, row_number() OVER (PARTITION BY symbol ORDER BY (reject = '')::INT DESC, rr DESC, -round(risk, 2) DESC, formed_pos, way) AS rank FROM lc WHERE life <> 'historical'")
def _(spark, d):
    bars = placed(spark, d)
    live = U.lifecycle(U.setups(bars), bars).where("state <> 'historical'").drop("state")
    return U.ranked_setups(live.withColumn("state", F.lit("live"))).select("symbol", "formed_pos", "way", F.col("rank").cast("long").alias("rank"))


@query("d41_trade_records", f"""{_ORDERS} SELECT id, symbol || '|' || CASE WHEN is_long THEN 'long' ELSE 'short' END || '|' || result || '|' || coalesce((round(realized * 1000))::BIGINT::VARCHAR, '') AS record FROM lb WHERE fill IS NOT NULL""")
def _(spark, d):
    rows = labelled(spark, d).where("fill is not null")
    milli = F.coalesce(F.round(F.col("realized") * 1000).cast("long").cast("string"), F.lit(""))
    return rows.select("id", F.concat_ws("|", "symbol", F.when(F.col("is_long"), "long").otherwise("short"), "result", milli).alias("record"))


@query("d42_distinct_records", f"""{_ORDERS}, k AS (SELECT id, symbol, decision, row_number() OVER (PARTITION BY symbol, is_long, round(stop, 4), floor(decision / 6) ORDER BY decision) AS rn FROM lb WHERE fill IS NOT NULL) SELECT id, symbol FROM k WHERE rn = 1""")
def _(spark, d):
    key = Window.partitionBy("symbol", "is_long", F.round("stop", 4), F.floor(F.col("decision") / 6)).orderBy("decision")
    rows = labelled(spark, d).where("fill is not null").withColumn("rn", F.row_number().over(key))
    return rows.where("rn = 1").select("id", "symbol")


@query("x11_round_trip_costs", f"{_DAILY.join(['WITH ', ''])} SELECT symbol, count(*) AS days, round((0.5 + 2 * 1.0) * 0.25 * 2.0 + 1.24, 6) AS cost FROM dd GROUP BY symbol")
def _(spark, d):
    return daily_orders(spark, d).groupBy("symbol").agg(F.count("*").alias("days")).withColumn("cost", F.round(C.round_trip_cost(1.24, 0.5, 1.0, 0.25, 2.0), 6))
