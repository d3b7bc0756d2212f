"""Trade and forecast statistics as aggregations."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _where(condition: Column, value: Column | str) -> Column:
    return F.when(condition, F.col(value) if isinstance(value, str) else value)


#: Conditions on a trade, as expressions.
WIN, LOSS = "pnl > 0", "pnl <= 0"


def profit_factor(pnl: str = "pnl") -> Column:
    """Gross profit by gross loss; infinite without losses."""
    gain, loss = F.sum(_where(F.col(pnl) > 0, pnl)), -F.sum(_where(F.col(pnl) <= 0, pnl))
    return F.when(F.coalesce(loss, F.lit(0.0)) > 0, F.coalesce(gain, F.lit(0.0)) / loss).otherwise(F.lit(float("inf")))


def trade_aggregates() -> dict[str, Column]:
    return {
        "n": F.count("*"), "win_rate": F.avg(F.when(F.expr(WIN), 1.0).otherwise(0.0)), "avg_r": F.avg("r"), "profit_factor": profit_factor(), "total_pnl": F.sum("pnl"),
        "avg_win": F.coalesce(F.avg(_where(F.expr(WIN), "pnl")), F.lit(0.0)), "avg_loss": F.coalesce(F.avg(_where(F.expr(LOSS), "pnl")), F.lit(0.0)), "largest_win": F.max("pnl"), "largest_loss": F.min("pnl"),
    }


def summary(trades: DataFrame, by: list[str]) -> DataFrame:
    return trades.groupBy(*by).agg(*(c.alias(n) for n, c in trade_aggregates().items()))


def breakdowns(trades: DataFrame, keys: list[str]) -> DataFrame:
    """The summary by each key alone and over all, in one pass: ``dimension``, ``value``."""
    cells = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys))
    return summary(trades.withColumn("cell", F.explode(cells)).select("*", "cell.dimension", "cell.value"), ["dimension", "value"])


def cube_counts(rows: DataFrame, keys: list[str], measure: Column) -> DataFrame:
    return rows.groupingSets([[F.col(k)] for k in keys] + [[]], *map(F.col, keys)).agg(measure)


def streaks(trades: DataFrame, by: str, order: str) -> DataFrame:
    """Longest runs of wins and of losses."""
    w = Window.partitionBy(by).orderBy(order)
    marked = trades.withColumn("win_", F.expr(WIN))
    marked = marked.withColumn("run_", F.sum((~F.col("win_").eqNullSafe(F.lag("win_").over(w))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(by, "run_", "win_").agg(F.count("*").alias("n"))
    longest = lambda flag: F.coalesce(F.max(F.when(F.col("win_") == flag, F.col("n"))), F.lit(0).cast("long"))
    return runs.groupBy(by).agg(longest(True).alias("max_wins"), longest(False).alias("max_losses"))


def drawdowns(trades: DataFrame, by: str, order: str, start: float) -> DataFrame:
    """Largest fall of start + cumulative pnl from its running maximum, in money and as a share."""
    line = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = trades.withColumn("equity", start + F.sum("pnl").over(line)).withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(line)))
    return curve.groupBy(by).agg(F.min(F.col("equity") - F.col("peak")).alias("drawdown"), F.min(F.col("equity") / F.col("peak") - 1).alias("drawdown_share"), F.max_by("equity", order).alias("final_equity"))


def sharpe(daily: DataFrame, by: str, value: str = "pnl", periods: int = 252) -> DataFrame:
    spread = F.stddev_samp(value)
    return daily.groupBy(by).agg(F.when(spread > 0, F.avg(value) / spread * math.sqrt(periods)).otherwise(0.0).alias("sharpe"))


def walk_forward(trades: DataFrame, by: str, at: str, windows: int) -> DataFrame:
    """Trades of equal time windows between each key's first and last entry; windows without trades stay."""
    span = trades.groupBy(by).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    width = (F.col("hi") - F.col("lo")) / windows
    cell = F.least(F.lit(windows - 1), F.floor((F.col(at) - F.col("lo")) / F.greatest(width, F.lit(1e-9))).cast("int"))
    counted = trades.join(span.select(by, "lo", "hi").distinct(), by).withColumn("w", cell).groupBy(by, "w").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.avg("r").alias("avg_r"))
    return span.select(by, "w").join(counted, [by, "w"], "left").select(by, "w", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("pnl", F.lit(0.0)).alias("pnl"), "avg_r")


def drop_best(daily: DataFrame, by: str, period: Column, value: str = "pnl") -> DataFrame:
    """Mean after the best period is taken out; the earliest of equally good ones."""
    sums = daily.withColumn("p_", period).withColumn("s_", F.sum(value).over(Window.partitionBy(by, "p_")))
    best = sums.groupBy(by).agg(F.min_by("p_", F.struct(-F.col("s_"), F.col("p_"))).alias("best"))
    return sums.join(best, by).where("p_ <> best").groupBy(by).agg(F.avg(value).alias("mean"))


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float], by: str) -> DataFrame:
    """Quantiles without interpolation: the value at index floor(share * n) of a group's sorted ones, null if it has none.

    Equal values are counted first; counts run up in order and nothing is gathered.
    """
    total = rows.groupBy(by).agg(F.count(value).alias("total_"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n_"))
    running = F.sum("n_").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = total.join(counts.withColumn("upto_", running), by, "left")
    index = lambda share: F.least(F.col("total_"), F.floor(share * F.col("total_")) + 1)
    return placed.groupBy(by).agg(*(F.min(F.when(F.col("upto_") >= index(share), F.col(value))).alias(name) for name, share in shares.items()))


def auc(scores: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """Area under the curve from average ranks, ties counted half."""
    w = Window.partitionBy(by).orderBy(score)
    ranked = scores.withColumn("rank_", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(by, score)) - 1) / 2)
    n1, n0 = F.sum(label), F.sum(1 - F.col(label))
    return ranked.groupBy(by).agg(F.try_divide(F.sum(F.col("rank_") * F.col(label)) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def spearman(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    rank = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2
    return rows.withColumn("ra", rank(a)).withColumn("rb", rank(b)).groupBy(by).agg(F.corr("ra", "rb").alias("rho"))


def interpolated(low: pd.Series, high: pd.Series, share: pd.Series) -> pd.Series:
    """low * (1 - share) + high * share with one rounding less, as the SQL's engine has it; equal values may give their neighbour."""
    return pd.Series([a if s == 0 else math.fma(a, 1.0 - s, b * s) for a, b, s in zip(low, high, share)], dtype=float)


def quantile_edges(rows: DataFrame, value: str, n: int, by: str) -> DataFrame:
    """The n - 1 interpolated quantile edges of each key (``edges_``), by running counts of equal values."""
    line = Window.partitionBy(by).orderBy(value)
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n_"))
    upto = counts.withColumn("to_", F.sum("n_").over(line)).withColumn("all_", F.sum("n_").over(Window.partitionBy(by)))
    place = lambda i: (F.col("all_") - 1) * F.lit(i / n)
    # a value holds the places to_ - n_ to to_ - 1, so it is the lower or upper neighbour of some edges' places
    holds = lambda at: (at >= F.col("to_") - F.col("n_")) & (at < F.col("to_"))
    near = F.filter(F.array(*(F.when(holds(F.floor(place(i))) | holds(F.ceil(place(i))), F.struct(F.lit(i).alias("i"), place(i).alias("at"))) for i in range(1, n))), lambda x: x.isNotNull())
    met = upto.select(by, value, F.explode(near).alias("e")).groupBy(by, "e").agg(F.min(value).alias("low_"), F.max(value).alias("high_"))
    edge = F.pandas_udf(interpolated, "double")(F.col("low_").cast("double"), F.col("high_").cast("double"), F.col("e.at") - F.floor("e.at"))
    return met.select(by, edge.alias("edge_")).groupBy(by).agg(F.sort_array(F.collect_list("edge_")).alias("edges_"))  # n - 1 a key


def quantile_cells(rows: DataFrame, value: str, n: int, by: str) -> DataFrame:
    """Cell (0..n-1) of each value between interpolated quantile edges, closed on the right."""
    joined = rows.join(quantile_edges(rows, value, n, by), by)
    return joined.withColumn("cell", F.size(F.filter("edges_", lambda e: e < F.col(value)))).drop("edges_")


def calibration(rows: DataFrame, p: str, label: str, n: int, by: str) -> DataFrame:
    cells = quantile_cells(rows, p, n, by)
    return cells.groupBy(by, "cell").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(label).alias("observed"))


def expected_calibration_error(table: DataFrame, by: str) -> DataFrame:
    return table.groupBy(by).agg((F.sum(F.abs(F.col("predicted") - F.col("observed")) * F.col("n")) / F.sum("n")).alias("ece"))


def prior_fold_percentile(rows: DataFrame, value: str, fold: str, by: str) -> DataFrame:
    """Share of all earlier folds' values below a row's; null in the first fold.

    Counts come from one running total over the sorted values per target fold,
    so folds times rows are touched, never pairs of rows.
    """
    folds = rows.select(by, fold).distinct().withColumnRenamed(fold, "target")
    placed = rows.join(folds, by).where(F.col(fold) <= F.col("target"))
    w = Window.partitionBy(by, "target").orderBy(value)
    earlier = (F.col(fold) < F.col("target")).cast("int")
    below = F.coalesce(F.sum(earlier).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum(earlier).over(Window.partitionBy(by, "target", value))
    total = F.sum(earlier).over(Window.partitionBy(by, "target"))
    counted = placed.withColumn("below", below).withColumn("total", total).where(F.col(fold) == F.col("target"))
    return counted.withColumn("percentile", F.when(F.col("total") > 0, F.col("below") / F.col("total"))).drop("target", "below", "total")


def deflated_sharpe(ratio: float, n: int, skew: float, kurtosis: float, trials: int, spread: float) -> float:
    """Probability that a per-period Sharpe ratio beats the best expected of ``trials`` null ones."""
    if n < 2:
        return 0.0
    normal = NormalDist()
    euler = 0.5772156649015329
    best = 0.0 if trials < 2 else spread * ((1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * math.e)))
    scale = math.sqrt(max(1e-12, 1 - skew * ratio + (kurtosis - 1) / 4 * ratio**2))
    return normal.cdf((ratio - best) * math.sqrt(n - 1) / scale)


def deflated_sharpes(daily: DataFrame, by: str, trials: int, spread: float, value: str = "pnl") -> DataFrame:
    """The deflated Sharpe probability of each key's daily results, from their moments."""
    moments = daily.groupBy(by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count("*").alias("n"), F.skewness(value).alias("sk"), F.kurtosis(value).alias("ku"))
    ratio = F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0)

    @F.pandas_udf("double")
    def deflated(r: pd.Series, n: pd.Series, skew: pd.Series, excess: pd.Series) -> pd.Series:
        return pd.Series([deflated_sharpe(a, int(b), c, k + 3, trials, spread) for a, b, c, k in zip(r, n, skew, excess)])

    finite = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return moments.select(by, deflated(ratio, "n", finite("sk"), finite("ku")).alias("p"))


def sign_stability(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, spread and share of the most frequent sign (the smaller of equally frequent ones; null if it is zero)."""
    signs = rows.groupBy(by, F.signum(F.round(value, 9)).alias("sign_")).agg(F.count("*").alias("n_"))
    major = signs.groupBy(by).agg(F.max_by("sign_", F.struct(F.col("n_"), -F.col("sign_"))).alias("s_"), F.max("n_").alias("m_"), F.sum("n_").alias("t_"))
    out = rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread")).join(major, by)
    return out.withColumn("consistency", F.when(F.col("s_") != 0, F.col("m_") / F.col("t_"))).drop("s_", "m_", "t_")


def deflated_best(daily: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each series' daily Sharpe ratio and its deflated probability among all of them (their number and spread)."""
    moments = daily.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count("*").alias("n"), F.skewness(value).alias("sk"), F.kurtosis(value).alias("ku"))
    moments = moments.withColumn("sharpe", F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0))
    tried = moments.agg(F.count("*").alias("trials"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("spread")).first()
    finite = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))

    @F.pandas_udf("double")
    def deflated(r: pd.Series, n: pd.Series, skew: pd.Series, excess: pd.Series) -> pd.Series:
        return pd.Series([deflated_sharpe(x, int(k), s, e + 3, tried.trials, tried.spread) for x, k, s, e in zip(r, n, skew, excess)])

    return moments.withColumn("p", deflated("sharpe", "n", finite("sk"), finite("ku"))).select(*by, "sharpe", "p")
