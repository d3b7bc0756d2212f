"""Features, forecasts and their evaluation over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import KEY, hourly, placed, r6, secs, swings
from barspark.catalog.sql import ATR, POS
from barspark.functions import scalars as C
from barspark.functions.session import eastern, minute_of_day
from barspark.operators import windows as V
from barspark.operators.windows import in_time
from barspark.plans import features as X
from barspark.plans import models as M
from barspark.plans import stats as S

_P = f"""{POS}, q AS (SELECT symbol, pos, ts, et, round(1 / (1 + exp(-(close - pc) / 100)), 9) AS p, CASE WHEN lead(close) OVER w < close THEN 1.0 ELSE 0.0 END AS y, CASE WHEN lead(close) OVER w IS NULL THEN 1 END AS dead FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
pr AS (SELECT * FROM q WHERE p IS NOT NULL AND dead IS NULL)"""


def scored(spark, d):
    """A deterministic probability that the next close falls, and whether it did."""
    nxt = F.lead("close").over(in_time())
    p = F.round(1 / (1 + F.exp(-(F.col("close") - F.lag("close").over(in_time())) / 100)), 9)  # so that equal moves tie
    frame = placed(spark, d).withColumn("p", p).withColumn("next", nxt).withColumn("y", F.when(F.col("next") < F.col("close"), 1.0).otherwise(0.0))
    return frame.where("p is not null and next is not null")


@query("x13_log_loss_and_brier", f"{_P} SELECT symbol, round(avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15))), 6) AS log_loss, round(avg(2 * pow(p - y, 2)), 6) AS brier FROM pr GROUP BY symbol")
def _(spark, d):
    chosen = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return scored(spark, d).groupBy("symbol").agg(r6(F.avg(C.neg_log_likelihood(chosen)), "log_loss"), r6(F.avg(2 * F.pow(F.col("p") - F.col("y"), 2)), "brier"))


@query("st18_auc", f"""{_P}, r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS rk FROM pr)
SELECT symbol, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY symbol""")
def _(spark, d):
    return S.auc(scored(spark, d), "p", "y", "symbol").select("symbol", r6("auc", "auc"))


@query("st20_spearman", f"""{_P}, r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS b FROM pr)
SELECT symbol, round(corr(a, b), 6) AS rho FROM r GROUP BY symbol""")
def _(spark, d):
    return S.spearman(scored(spark, d), "p", "y", "symbol").select("symbol", r6("rho", "rho"))


_CAL = f"""{_P}, e AS (SELECT symbol, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM pr GROUP BY symbol),
c AS (SELECT pr.*, len(list_filter(edges, lambda v: v < p)) AS cell FROM pr JOIN e USING (symbol)), t AS (SELECT symbol, cell, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM c GROUP BY ALL)"""


@query("g22_calibration_table", f"{_CAL} SELECT symbol, cell, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM t")
def _(spark, d):
    table = S.calibration(scored(spark, d), "p", "y", 10, "symbol")
    return table.select("symbol", F.col("cell").cast("long").alias("cell"), "n", r6("predicted", "predicted"), r6("observed", "observed"))


@query("g23_expected_calibration_error", f"{_CAL} SELECT symbol, round(sum(abs(predicted - observed) * n) / sum(n), 6) AS ece FROM t GROUP BY symbol")
def _(spark, d):
    return S.expected_calibration_error(S.calibration(scored(spark, d), "p", "y", 10, "symbol"), "symbol").select("symbol", r6("ece", "ece"))


@query("g35_confusion", f"{_P} SELECT symbol, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM pr GROUP BY symbol")
def _(spark, d):
    yes, true = F.col("p") >= 0.5, F.col("y") == 1
    cells = {"tp": yes & true, "fp": yes & ~true, "fn": ~yes & true, "tn": ~yes & ~true}
    return scored(spark, d).groupBy("symbol").agg(*(F.count_if(c).alias(n) for n, c in cells.items()))


@query("g36_factor_separation", f"{_P} SELECT symbol, round(corr(p, y), 6) AS point_biserial, round((avg(p) FILTER (WHERE y = 1) - avg(p) FILTER (WHERE y = 0)) / sqrt((var_samp(p) FILTER (WHERE y = 1) + var_samp(p) FILTER (WHERE y = 0)) / 2), 6) AS cohen_d FROM pr GROUP BY symbol")
def _(spark, d):
    part = lambda f, v: f(F.when(F.col("y") == v, F.col("p")))
    pooled = F.sqrt((part(F.var_samp, 1) + part(F.var_samp, 0)) / 2)
    return scored(spark, d).groupBy("symbol").agg(r6(F.corr("p", "y"), "point_biserial"), r6(F.try_divide(part(F.avg, 1) - part(F.avg, 0), pooled), "cohen_d"))


_FOLD = f"""{_P}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM pr),
f AS (SELECT *, list_sum(list_transform(range(8), lambda k: (i >= floor(floor(0.2 * n) + (n - floor(0.2 * n)) * k / 8))::INT)) - 1 AS fold FROM n)"""


def folded(spark, d):
    return M.numbered(scored(spark, d), "pos", "symbol").withColumn("fold", M.expanding_fold())


@query("ml01_expanding_folds", f"{_FOLD} SELECT symbol, fold::INT AS fold, count(*) AS n, min(i) AS first FROM f GROUP BY symbol, fold")
def _(spark, d):
    return folded(spark, d).groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("i").cast("long").alias("first"))


@query("ml05_purged_splits", f"""{_P}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM pr),
f AS (SELECT symbol, pos AS entry_pos, pos + 6 AS exit_pos, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM n),
t AS (SELECT symbol, fold AS test_fold, min(entry_pos) AS fr FROM f WHERE fold > 0 GROUP BY ALL)
SELECT t.symbol, t.test_fold::INT AS test_fold, count(*) AS n, max(f.exit_pos) AS last_exit FROM f JOIN t USING (symbol) WHERE f.fold < t.test_fold AND f.exit_pos < t.fr - 12 GROUP BY ALL""")
def _(spark, d):
    rows = M.numbered(scored(spark, d), "pos", "symbol").withColumn("fold", M.even_fold(5))
    rows = rows.select("symbol", "fold", F.col("pos").alias("entry_pos"), (F.col("pos") + 6).alias("exit_pos"))
    return M.purged_pairs(rows, "symbol", 5, 12).groupBy("symbol", "test_fold").agg(F.count("*").alias("n"), F.max("exit_pos").cast("long").alias("last_exit"))


@query("st21_prior_fold_percentile", f"""{_FOLD} SELECT f.symbol, f.pos, round(count(o.pos) FILTER (WHERE o.p < f.p) / count(o.pos)::DOUBLE, 6) AS percentile FROM f LEFT JOIN f o ON o.symbol = f.symbol AND o.fold >= 0 AND o.fold < f.fold WHERE f.fold >= 0 GROUP BY f.symbol, f.pos""")
def _(spark, d):
    rows = folded(spark, d).where("fold >= 0").select("symbol", "pos", "p", "fold")
    return S.prior_fold_percentile(rows, "p", "fold", "symbol").select("symbol", F.col("pos").cast("long").alias("pos"), r6("percentile", "percentile"))


_RV = f"""{POS}, g AS (SELECT symbol, pos, ts, et, close, CASE WHEN low > 0 AND open > 0 AND close > 0 THEN 0.5 * pow(ln(high) - ln(low), 2) - (2 * ln(2) - 1) * pow(ln(close) - ln(open), 2) END AS v FROM x),
lg AS (SELECT *, lag(v) OVER w AS v1, avg(v) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS v6 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
al AS (SELECT *, CASE WHEN v > 0 THEN ln(v) END AS y, CASE WHEN v1 > 0 THEN ln(v1) END AS x1, CASE WHEN v6 > 0 THEN ln(v6) END AS x2, hour(et) AS slot FROM lg),
rv AS (SELECT * FROM al WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)"""


def variance(spark, d):
    """Garman-Klass variance of each bar, its log and those of the last bar's and the last six's; null where not positive."""
    ln = lambda c: F.when(c > 0, F.ln(c))
    frame = placed(spark, d).withColumn("v", C.garman_klass())
    return frame.withColumn("y", ln(F.col("v"))).withColumn("x1", ln(F.lag("v").over(in_time()))).withColumn("x2", ln(F.avg("v").over(V.rows(-6, -1)))).withColumn("slot", F.hour(eastern(F.col("ts"))))


def logs(spark, d):
    """Bars whose log variance and both forecasts of it are known."""
    return variance(spark, d).where("y is not null and x1 is not null and x2 is not null")


def steady(column, name: str):
    """Rounded to about nine digits, so that the order of sums does not show."""
    size = F.abs(column)
    return F.when(size < 1e3, F.round(column, 5)).when(size < 1e7, F.round(column, 1)).otherwise(F.round(column, -4)).alias(name)


def _steady(expression: str, name: str) -> str:
    return f"CASE WHEN abs({expression}) < 1e3 THEN round({expression}, 5) WHEN abs({expression}) < 1e7 THEN round({expression}, 1) ELSE round({expression}, -4) END AS {name}"


_Q1, _Q2 = "avg(v / exp(x1) - ln(v / exp(x1)) - 1)", "avg(v / exp(x2) - ln(v / exp(x2)) - 1)"


@query("x12_garman_klass", f"{_RV} SELECT symbol, pos, round(v, 6) AS v FROM al")
def _(spark, d):
    return variance(spark, d).select("symbol", F.col("pos").cast("long").alias("pos"), r6("v", "v"))


@query("st13_qlike", f"{_RV} SELECT symbol, {_steady(_Q1, 'persistence')}, {_steady(_Q2, 'trailing')} FROM rv GROUP BY symbol")
def _(spark, d):
    rows = logs(spark, d)
    score = lambda x, n: steady(F.avg(C.qlike(F.col("v"), F.exp(x))), n)
    return rows.groupBy("symbol").agg(score("x1", "persistence"), score("x2", "trailing"))


@query("st17_mincer_zarnowitz", f"{_RV} SELECT symbol, round(regr_slope(y, x2), 6) AS slope, round(regr_intercept(y, x2), 6) AS intercept, round(regr_r2(y, x2), 6) AS r2 FROM rv GROUP BY symbol")
def _(spark, d):
    return logs(spark, d).groupBy("symbol").agg(r6(F.regr_slope("y", "x2"), "slope"), r6(F.regr_intercept("y", "x2"), "intercept"), r6(F.regr_r2("y", "x2"), "r2"))


@query("st15_r2_and_log_errors", f"{_RV} SELECT symbol, round(avg(pow(y - x2, 2)), 6) AS mse, round(avg(abs(y - x2)), 6) AS mae, round(1 - sum(pow(y - x2, 2)) / nullif(var_pop(y) * count(*), 0), 6) AS r2 FROM rv GROUP BY symbol")
def _(spark, d):
    off = F.col("y") - F.col("x2")
    rows = logs(spark, d)
    return rows.groupBy("symbol").agg(r6(F.avg(F.pow(off, 2)), "mse"), r6(F.avg(F.abs(off)), "mae"), r6(1 - F.try_divide(F.sum(F.pow(off, 2)), F.var_pop("y") * F.count("*")), "r2"))


@query("ml08_har_coefficients", f"""{_RV}, s AS (SELECT symbol, var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM rv GROUP BY symbol),
b AS (SELECT *, CASE WHEN a * c - b * b > 1e-9 * a * c THEN (p * c - q * b) / (a * c - b * b) END AS b1, CASE WHEN a * c - b * b > 1e-9 * a * c THEN (q * a - p * b) / (a * c - b * b) END AS b2 FROM s) SELECT symbol, round(my - b1 * m1 - b2 * m2, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM b""")
def _(spark, d):
    table = M.gram(logs(spark, d), ["x1", "x2"], "y", ["symbol"])
    beta = M.linear(["x1", "x2"], table, ["symbol"], [0.0])
    return beta.select("symbol", *(F.round(F.col("beta")[i], 5).alias(f"b{i}") for i in range(3)))


@query("ml09_climatology", f"{_RV}, s AS (SELECT symbol, slot, avg(y) AS m FROM rv GROUP BY ALL) SELECT s.symbol, slot, round(m, 6) AS slot_mean, round(o.am, 6) AS all_mean FROM s JOIN (SELECT symbol, avg(y) AS am FROM rv GROUP BY symbol) o USING (symbol)")
def _(spark, d):
    return M.climatology(logs(spark, d), ["symbol"], "slot", "y").select("symbol", F.col("slot").cast("long").alias("slot"), r6("slot_mean", "slot_mean"), r6("all_mean", "all_mean"))


@query("ml11_smearing_factor", f"{_RV} SELECT symbol, {_steady('avg(exp(y - x2))', 'smear')} FROM rv GROUP BY symbol")
def _(spark, d):
    return M.smearing(logs(spark, d), "y", "x2", ["symbol"]).select("symbol", steady(F.col("smear"), "smear"))


@query("ml12_baseline_selection", f"""{_RV}, s AS (SELECT symbol, round(avg(v / exp(x1) - ln(v / exp(x1)) - 1), 5) AS a, round(avg(v / exp(x2) - ln(v / exp(x2)) - 1), 5) AS b FROM rv GROUP BY symbol) SELECT symbol, CASE WHEN a <= b THEN 'persistence' ELSE 'trailing' END AS chosen FROM s""")
def _(spark, d):
    score = lambda x: F.round(F.avg(C.qlike(F.col("v"), F.exp(x))), 5)
    both = logs(spark, d).groupBy("symbol").agg(score("x1").alias("a"), score("x2").alias("b"))
    return both.select("symbol", F.when(F.col("a") <= F.col("b"), "persistence").otherwise("trailing").alias("chosen"))


@query("g29_regime_terciles", f"{_RV}, e AS (SELECT symbol, quantile_cont(v, 1 / 3.0) AS a, quantile_cont(v, 2 / 3.0) AS b FROM rv GROUP BY symbol) SELECT symbol, CASE WHEN v <= a THEN 'low' WHEN v <= b THEN 'mid' ELSE 'high' END AS regime, count(*) AS n, round(avg(y), 6) AS mean, round(avg(y) / nullif(stddev_samp(y) / sqrt(count(*)), 0), 5) AS t FROM rv JOIN e USING (symbol) GROUP BY ALL")
def _(spark, d):
    rows = logs(spark, d)
    edges = rows.groupBy("symbol").agg(F.percentile("v", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    regime = F.when(F.col("v") <= F.col("e")[0], "low").when(F.col("v") <= F.col("e")[1], "mid").otherwise("high")
    out = rows.join(edges, "symbol").withColumn("regime", regime).groupBy("symbol", "regime")
    return out.agg(F.count("*").alias("n"), r6(F.avg("y"), "mean"), F.round(F.try_divide(F.avg("y"), F.stddev_samp("y") / F.sqrt(F.count("*"))), 5).alias("t"))


@query("g27_daily_paired_improvement", f"{_RV} SELECT symbol, et::DATE::VARCHAR AS day, {_steady(f'({_Q1} - {_Q2})', 'gain')} FROM rv GROUP BY symbol, et::DATE")
def _(spark, d):
    rows = logs(spark, d).withColumn("day", F.to_date(eastern(F.col("ts"))).cast("string"))
    score = lambda x: F.avg(C.qlike(F.col("v"), F.exp(x)))
    return rows.groupBy("symbol", "day").agg(steady(score("x1") - score("x2"), "gain"))


@query("x10_expected_value", f"{_P} SELECT symbol, pos, round(0.5 * (p * 1.5 - (0.8 - p * 0.5) * 1.5 + (1 - p - (0.8 - p * 0.5)) * 0.1) - 1.2, 6) AS ev FROM pr")
def _(spark, d):
    p = F.col("p")
    down = 0.8 - p * 0.5
    return scored(spark, d).select("symbol", F.col("pos").cast("long").alias("pos"), r6(C.expected_value(p, down, 1 - p - down, 1.5, F.lit(0.1), 0.5, 1.2), "ev"))


@query("d05_market_state_features")
def _(spark, d):
    return X.market_state(swings(spark, d), causal=True).select("symbol", secs(), *(r6(c, c) for c in X.MARKET_STATE))


@query("d06_intraday_features")
def _(spark, d):
    return X.intraday(placed(spark, d)).select("symbol", secs(), *(r6(c, c) for c in X.INTRADAY))


@query("d07_volatility_features")
def _(spark, d):
    return X.volatility(placed(spark, d)).select("symbol", secs(), *(r6(c, c) for c in X.VOLATILITY))


@query("d08_forward_variance_labels", f"""{POS}, m AS (SELECT *, hour(et) * 60 + minute(et) AS t, et::DATE AS day FROM x), r AS (SELECT *, pow(ln(close) - ln(lag(close) OVER w), 2) AS sq FROM m WHERE t >= 570 AND t < 960 WINDOW w AS (PARTITION BY symbol, et::DATE ORDER BY ts))
SELECT {KEY}, CASE WHEN count(sq) OVER f = 3 THEN round(sum(sq) OVER f, 6) END AS rv, round(greatest(max(high) OVER f - close, close - min(low) OVER f), 6) AS excursion FROM r WINDOW f AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def _(spark, d):
    t = minute_of_day(eastern(F.col("ts")))
    day = V.day_window()
    rows = hourly(spark, d).where((t >= 570) & (t < 960)).withColumn("sq", F.pow(V.log_return(day), 2))
    ahead = V.rows(1, 3, day)
    excursion = F.greatest(F.max("high").over(ahead) - F.col("close"), F.col("close") - F.min("low").over(ahead))
    return rows.select("symbol", secs(), r6(V.forward_sum(F.col("sq"), 3, day), "rv"), r6(excursion, "excursion"))


@query("ml13_ridge_walk_forward")
def _(spark, d):
    test = M.ridge_walk_forward(logs(spark, d), ["x1", "x2"], "y", "v", "symbol", "pos")
    loss, base = F.avg(C.qlike(F.col("v"), F.col("forecast"))), F.avg(C.qlike(F.col("v"), F.exp("x2")))
    return test.groupBy("symbol", "fold", "alpha").agg(F.count("*").alias("n"), steady(F.first("smear"), "smear"), steady(loss, "qlike"), steady(base, "baseline"))


@query("ml02_multinomial_walk_forward")
def _(spark, d):
    nxt = F.lead("close").over(in_time())
    frame = logs(spark, d).withColumn("label", F.when(nxt > F.col("close"), 2).when(nxt < F.col("close"), 0).when(nxt.isNotNull(), 1))
    test = M.multinomial_walk_forward(frame, ["x1", "x2"], "label", [0, 1, 2], "symbol", "pos")
    own = lambda c: C.neg_log_likelihood(F.element_at(c, F.col("label") + 1))
    return test.groupBy("symbol", F.col("test_fold").alias("fold")).agg(F.count("*").alias("n"), r6(F.avg(own("proba")), "model"), r6(F.avg(own("prior")), "prior"))


@query("st10_deflated_sharpe")
def _(spark, d):
    from barspark.catalog.trades import trades

    daily = trades(spark, d).groupBy("symbol", "day").agg(F.sum("pnl").alias("pnl"))
    return S.deflated_sharpes(daily, "symbol", trials=6, spread=0.1).select("symbol", r6("p", "p"))
