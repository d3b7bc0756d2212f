"""Walk-forward evaluation and the forecasting models.

Models come from sums: an aggregation yields the Gram matrix of a fold's features,
or the slope and curvature of its likelihood; the few coefficients of each fold
are solved where its sums lie, and go back to the rows in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.sources.shared import written


def numbered(rows: DataFrame, order: str, by: str) -> DataFrame:
    """``i`` and ``n``: place and number of rows of a key."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))


def expanding_fold(start: float = 0.2, folds: int = 8) -> Column:
    """Test fold of row i of n: -1 in the initial training part, then equal parts with truncated edges."""
    first = F.floor(start * F.col("n"))
    edge = lambda k: F.floor(first + (F.col("n") - first) * k / folds)
    return sum(((F.col("i") >= edge(k)).cast("int") for k in range(folds)), F.lit(0)) - 1


def even_fold(folds: int) -> Column:
    """Fold of row i of n where the first n mod folds parts hold one row more."""
    size, rest = F.floor(F.col("n") / folds), F.col("n") % folds
    wide = rest * (size + 1)
    return F.when(F.col("i") < wide, F.floor(F.col("i") / (size + 1))).otherwise(rest + F.floor((F.col("i") - wide) / F.greatest(size, F.lit(1)))).cast("int")


def purged_pairs(rows: DataFrame, by: str, folds: int, embargo: int) -> DataFrame:
    """Training rows of each test fold: earlier folds whose exit lies before the test's first entry less the embargo."""
    first = rows.groupBy(by, "fold").agg(F.min("entry_pos").alias("from_")).where("fold > 0").withColumnRenamed("fold", "test_fold")
    return rows.join(first, by).where((F.col("fold") < F.col("test_fold")) & (F.col("exit_pos") < F.col("from_") - embargo)).drop("from_")


def before_folds(rows: DataFrame, by: str, fold: str, sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows of the folds before each test fold: one aggregation by fold and a running total over folds."""
    cells = rows.groupBy(by, fold).agg(*(c.alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(by).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(by, fold, *(F.sum(n).over(earlier).alias(n) for n in sums)).where(F.col(fold) >= 0)


def gram(rows: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """Sums of products of (1, features, target): all that least squares needs."""
    x = [F.lit(1.0), *map(F.col, features), F.col(target)]
    cells = [F.sum(x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return rows.where(" and ".join(f"{c} is not null" for c in [*features, target])).groupBy(*by).agg(*cells)


def solve(row, k: int, alpha: float = 0.0) -> np.ndarray:  # noqa: ANN001
    """Intercept and coefficients by (standardized ridge) least squares from a gram row; k features."""
    g = np.zeros((k + 2, k + 2))
    for i in range(k + 2):
        for j in range(i, k + 2):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:k] / n, 0))
    scale[scale == 0] = 1
    a = cov[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    if not alpha and np.linalg.det(cov[:k, :k] / np.outer(scale, scale) / n) <= 1e-9:
        return np.full(k + 1, np.nan)  # features that tell too little apart
    beta = np.linalg.lstsq(a, cov[:k, k] / scale, rcond=None)[0] / scale
    return np.concatenate([[mean[k] - beta @ mean[:k]], beta])


def linear(features: list[str], table: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """Coefficients of each group of a gram table for each ridge weight: columns of ``by``, alpha, beta."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(*(r[c] for c in by), a, [None if v != v else v for v in solve(r, len(features), a).tolist()]) for _, r in part.iterrows() for a in alphas]
            yield pd.DataFrame(rows, columns=[*by, "alpha", "beta"])

    kinds = dict(table.dtypes)
    return table.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", alpha double, beta array<double>")


def predicted(features: list[str]) -> Column:
    x = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in features))
    return F.aggregate(F.zip_with("beta", x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)


def climatology(rows: DataFrame, by: list[str], slot: str, target: str) -> DataFrame:
    """Mean of each slot, the overall mean where a slot has none."""
    slots = rows.groupBy(*by, slot).agg(F.avg(target).alias("slot_mean"))
    overall = rows.groupBy(*by).agg(F.avg(target).alias("all_mean"))
    return slots.join(overall, by)


def smearing(rows: DataFrame, actual: str, forecast: str, by: list[str]) -> DataFrame:
    """Mean of exp(residual): what a forecast of logs is multiplied with."""
    return rows.groupBy(*by).agg(F.avg(F.exp(F.col(actual) - F.col(forecast))).alias("smear"))


#: Ridge weights that are tried.
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


def ridge_walk_forward(rows: DataFrame, features: list[str], target: str, variance: str, by: str, order: str, folds: int = 4, inner: int = 5, horizon: int = 1, embargo: int = 6, alphas: list[float] = ALPHAS) -> DataFrame:
    """Out-of-sample forecasts of a log variance: rows of the test folds with alpha, smear and forecast.

    Test folds train on earlier ones, purged.  Inside a test fold's training rows,
    inner folds do the same for each alpha; the alpha of least loss, after
    smearing, is fitted anew on all of them, and exp(forecast of the log) is
    multiplied by that alpha's smearing factor.
    """
    clean = rows.where(" and ".join(f"{c} is not null" for c in [*features, target, variance]))
    clean = numbered(clean, order, by).withColumn("fold", even_fold(folds)).withColumn("entry_pos", F.col(order)).withColumn("exit_pos", F.col(order) + horizon)
    train = purged_pairs(clean, by, folds, embargo).withColumn("run", F.concat_ws(":", by, "test_fold")).drop("i", "n", "fold")
    nested = numbered(train, order, "run").withColumn("fold", even_fold(inner + 1))
    pairs = purged_pairs(nested.drop("test_fold"), "run", inner + 1, embargo)
    beta = linear(features, gram(pairs, features, target, ["run", "test_fold"]), ["run", "test_fold"], alphas)
    tried = nested.drop("test_fold").join(beta.withColumnRenamed("test_fold", "fold"), ["run", "fold"]).withColumn("mu", predicted(features))
    # the mean loss of a smeared forecast from three means: of v / exp(mu), of its log and of the residuals
    y, mu, v = F.col(target), F.col("mu"), F.col(variance)
    scored = tried.groupBy("run", "alpha").agg(F.avg(F.exp(y - mu)).alias("smear"), F.avg(v / F.exp(mu)).alias("ratio"), F.avg(F.ln(v) - mu).alias("logs"))
    scored = scored.withColumn("loss", F.col("ratio") / F.col("smear") - F.col("logs") + F.ln("smear") - 1)
    chosen = scored.groupBy("run").agg(F.min_by(F.struct("alpha", "smear"), F.struct("loss", "alpha")).alias("best")).select("run", "best.*")
    final = linear(features, gram(train, features, target, ["run"]), ["run"], alphas).join(chosen, ["run", "alpha"])
    test = clean.where("fold > 0").withColumn("run", F.concat_ws(":", by, "fold")).join(final, "run")
    return test.withColumn("forecast", F.col("smear") * F.exp(predicted(features))).drop("beta", "run")


def multinomial_walk_forward(rows: DataFrame, features: list[str], label: str, classes: list[int], by: str, order: str, start: float = 0.2, folds: int = 8, l2: float = 1.0, steps: int = 12) -> DataFrame:
    """Test rows of expanding folds with ``proba`` (by class) and ``prior`` (the training shares), out of sample.

    A fold trains on all rows before it.  Its standardized multinomial logistic
    model is fitted by Newton steps, each from sums over the training rows:
    slope and curvature are aggregated, the next weights solved from them.
    """
    k, d = len(classes), len(features) + 1
    clean = numbered(rows.where(" and ".join(f"{c} is not null" for c in [*features, label])), order, by).withColumn("fold", expanding_fold(start, folds))
    first = clean.where("fold >= 0").groupBy(by, "fold").agg(F.min("i").alias("from_")).withColumnRenamed("fold", "test_fold")
    train = clean.select(by, "i", label, *features).join(first, by).where("i < from_")
    moments = train.groupBy(by, "test_fold").agg(
        F.count("*").alias("rows"), F.array(*(F.avg(c) for c in features)).alias("mean"), F.array(*(F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0) for c in features)).alias("scale"),
        F.array(*(F.count_if(F.col(label) == c) for c in classes)).alias("seen"),
    )
    z = lambda frame: frame.join(moments, [by, "test_fold"]).withColumn("z", F.array(F.lit(1.0), *((F.col(c) - F.col("mean")[i]) / F.col("scale")[i] for i, c in enumerate(features))))
    train = written(z(train).select(by, "test_fold", "z", F.col(label).alias("label")), "multinomial")

    def proba(frame: DataFrame) -> DataFrame:
        scores = F.array(*(sum((F.col("w")[c * d + j] * F.col("z")[j] for j in range(d)), F.lit(0.0)) for c in range(k)))
        odds = F.transform("scores", lambda x: F.exp(x - F.array_max("scores")))
        total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
        return frame.withColumn("scores", scores).withColumn("odds", odds).withColumn("proba", F.transform("odds", lambda x: x / total)).drop("scores", "odds")

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        penalty = np.tile(np.append(1e-6, np.full(d - 1, l2)), k)
        for part in batches:
            out = []
            for _, r in part.iterrows():
                w, h = np.array(r["w"], float), np.zeros((k * d, k * d))
                slope = np.array([r[f"s_{c}_{j}"] for c in range(k) for j in range(d)]) + penalty * w
                for a in range(k):
                    for b in range(k):
                        for i in range(d):
                            for j in range(d):
                                h[a * d + i, b * d + j] = r[f"h_{min(a, b)}_{max(a, b)}_{min(i, j)}_{max(i, j)}"]
                out.append((r[by], r["test_fold"], (w - np.linalg.lstsq(h + np.diag(penalty), slope, rcond=None)[0]).tolist()))
            yield pd.DataFrame(out, columns=[by, "test_fold", "w"])

    weights = moments.select(by, "test_fold", F.array_repeat(F.lit(0.0), k * d).alias("w"))
    kinds = dict(moments.dtypes)
    for _ in range(steps):
        p = [F.col("proba")[c] for c in range(k)]
        x = [F.col("z")[j] for j in range(d)]
        sums = [F.sum((p[c] - (F.col("label") == classes[c]).cast("int")) * x[j]).alias(f"s_{c}_{j}") for c in range(k) for j in range(d)]
        sums += [F.sum(p[a] * (float(a == b) - p[b]) * x[i] * x[j]).alias(f"h_{a}_{b}_{i}_{j}") for a in range(k) for b in range(a, k) for i in range(d) for j in range(i, d)]
        sums = proba(train.join(weights, [by, "test_fold"])).groupBy(by, "test_fold").agg(F.first("w").alias("w"), *sums)
        weights = written(sums.mapInPandas(solved, f"{by} {kinds[by]}, test_fold {kinds['test_fold']}, w array<double>"), "multinomial-weights")
    test = z(clean.where("fold >= 0").withColumnRenamed("fold", "test_fold")).join(weights, [by, "test_fold"])
    return proba(test).withColumn("prior", F.transform("seen", lambda n: n / F.col("rows"))).drop("z", "w", "mean", "scale", "seen", "rows")
