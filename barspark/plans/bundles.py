"""Frozen models of all symbols in one table: fitted once, stored, and scored later by a join.

A bundle's row has the symbol, its classes' weights on raw features (so that
scoring needs nothing else), each class's mean return in units of ATR, the cost of a
round trip in money and what it was fitted on.  All symbols are fitted together
by aggregations; coefficients stay in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import bucket
from barspark.operators import windows as V
from barspark.plans import logistic as L
from barspark.plans.features import MARKET_STATE

#: Edges of the classes of a forward return in units of ATR.
EDGES = [-1.5, -0.5, 0.5, 1.5]
#: Features that an earlier version let a day's first bars see too soon; the causal bundle does without.
LEAKY = ["gap_atr_ratio", "overnight_imbalance_pctile"]
CAUSAL = [c for c in MARKET_STATE if c not in LEAKY]


def labelled(matrix: DataFrame, horizon: int) -> DataFrame:
    """A feature matrix (with close, atr and ts) with ``ahead``, the forward return, its class ``label`` and ``known_at``, the bar that tells it."""
    rows = matrix.withColumn("ahead", V.forward_return(horizon)).withColumn("known_at", F.lead("ts", horizon).over(V.in_time()))
    return rows.withColumn("label", bucket(F.col("ahead"), EDGES).cast("int"))


def build(rows: DataFrame, features: list[str], until: Column, cost: float, point_value: float, penalty: float = 1.0, settled: bool = False) -> DataFrame:
    """A bundle for every symbol with rows of at least two classes whose bars are not after ``until`` (a column of the rows).

    Rows lacking a feature or the label take no part.  With ``settled`` a row's
    label must be known by then too; else its bar alone counts.  Penalized softmax
    regression on standardized features; a class that a symbol never saw has no
    probability.
    """
    k, d = len(EDGES) + 1, len(features) + 1
    train = rows.where(F.col("known_at" if settled else "ts") <= until).dropna(subset=[*features, "label", "ahead"])
    spread = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    facts = train.groupBy("symbol").agg(
        F.array(*(F.avg(c) for c in features)).alias("mean"), F.array(*(spread(c) for c in features)).alias("scale"), F.count("*").alias("n_train"), F.count_distinct("label").alias("kinds"),
        F.array(*(F.coalesce(F.avg(F.when(F.col("label") == c, F.col("ahead"))), F.lit(0.0)) for c in range(k))).alias("returns"), F.min("ts").alias("trained_from"), F.max("ts").alias("trained_until"),
    ).where("kinds >= 2").drop("kinds")
    z = F.array(F.lit(1.0), *((F.col(c) - F.col("mean")[i]) / F.col("scale")[i] for i, c in enumerate(features)))
    placed = train.join(facts.select("symbol", "mean", "scale"), "symbol").select(F.col("symbol").alias("run"), "label", F.lit(1.0).alias("weight"), z.alias("z"))
    found = L.fit(placed, L.zeros(facts.select(F.col("symbol").alias("run")), k, d, [penalty]), k).withColumnRenamed("run", "symbol").join(facts, "symbol")
    # weights on raw features: w / scale each, the intercept less what the means add
    raw = lambda c: [F.col("w")[c * d + 1 + i] / F.col("scale")[i] for i in range(d - 1)]
    vectors = [F.array(F.col("w")[c * d] - sum((b * F.col("mean")[i] for i, b in enumerate(raw(c))), F.lit(0.0)), *raw(c)) for c in range(k)]
    return found.select("symbol", F.array(*map(F.lit, features)).alias("features"), F.flatten(F.array(*vectors)).alias("w"), "seen", "returns", F.lit(cost).alias("cost"), F.lit(point_value).alias("point_value"), "n_train", "trained_from", "trained_until")


def score(rows: DataFrame, bundle: DataFrame, features: list[str]) -> DataFrame:
    """Rows of the bundle's symbols with ``proba`` (by class), ``ev`` in units of ATR and ``cost_hurdle``; all null where a feature is.

    A bundle fitted on other features is an error.
    """
    k, d = len(EDGES) + 1, len(features) + 1
    full = F.lit(True)
    for c in features:
        full = full & F.col(c).isNotNull()
    own = F.when(F.col("features") == F.array(*map(F.lit, features)), F.lit(True)).otherwise(F.raise_error(F.lit("the bundle was fitted on other features")))
    held = bundle.where(own).select("symbol", "w", "seen", "returns", "cost", "point_value")
    out = rows.join(held, "symbol").withColumn("z", F.array(F.lit(1.0), *(F.col(c).cast("double") for c in features))).withColumn("proba", F.when(full, L.probabilities(k, d)))
    ev = F.aggregate(F.zip_with("proba", "returns", lambda p, r: p * r), F.lit(0.0), lambda a, v: a + v)
    hurdle = F.when(full & (F.col("atr") > 0), F.col("cost") / (F.col("atr") * F.col("point_value")))
    return out.withColumn("ev", ev).withColumn("cost_hurdle", hurdle).drop("w", "seen", "returns", "cost", "point_value", "z")
