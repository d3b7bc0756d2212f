"""Comparison of what the chain found with marks from elsewhere, and baseline classifiers of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.sources.shared import written

#: How far, as a share of the marked price, a candidate may lie from a mark.
NEAR = 0.0025


def compared(candidates: DataFrame, marks: DataFrame, engine: DataFrame, scene: list[str], near: float = NEAR) -> DataFrame:
    """A row for each scene and marked dimension: agree, engine_rank, n_candidates, category of a disagreement.

    ``candidates``: scene, dimension, way, price, rank (from 1, unique in a scene's
    dimension).  ``marks``: scene, decision (LONG, SHORT, NO_TRADE), manipulation_way,
    manipulation, shift, gap (prices), zone; a null is no mark.  ``engine``: scene,
    engine_decision (LONG, SHORT, NO-TRADE), n_setups, has_range.

    A mark is met by the nearest candidate (of its way, for a manipulation), the
    better ranked of equally near ones, within ``near`` of its price.  Categories:
    detector (not found), context (the other way), ranking (found, not first),
    mechanization (setups, but none taken), ambiguity.  A zone has no way of
    agreement but that there is a range; without one ``agree`` is null and the
    category context.
    """
    prices = marks.select(*scene, F.expr("stack(3, 'manipulation', manipulation, manipulation_way, 'shift', shift, null, 'gap', gap, null) as (dimension, level, mark_way)")).where("level is not null")
    far = F.struct(F.abs(F.col("price") - F.col("level")).alias("off"), "rank")
    fits = F.col("mark_way").isNull() | (F.col("way") == F.col("mark_way"))
    met = prices.join(candidates, [*scene, "dimension"], "left").groupBy(*scene, "dimension", "level", "mark_way").agg(
        F.count("rank").alias("n_candidates"), F.min(F.when(fits & F.col("rank").isNotNull(), far)).alias("best"), F.min_by("way", "rank").alias("top_way")
    )
    close = F.col("best.off") <= F.greatest(F.abs("level") * near, F.lit(1e-9))
    met = met.withColumn("engine_rank", F.when(close, F.col("best.rank"))).withColumn("agree", F.coalesce(F.col("engine_rank") == 1, F.lit(False)))
    conflict = F.coalesce(F.col("top_way") != F.col("mark_way"), F.lit(False))
    category = F.when(F.col("agree"), None).when(F.col("engine_rank").isNull(), "detector").when(conflict, "context").when(F.col("engine_rank") > 1, "ranking").otherwise("ambiguity")
    found = met.withColumn("category", category).select(*scene, "dimension", "agree", "engine_rank", "n_candidates", "category")

    both = marks.join(engine, scene, "left").withColumn("engine_decision", F.coalesce("engine_decision", F.lit("NO-TRADE")))
    same = F.col("decision") == F.translate("engine_decision", "-", "_")
    opposite = F.col("engine_decision").isin("LONG", "SHORT") & F.col("decision").isin("LONG", "SHORT")
    why = F.when(same, None).when(opposite, "context").when((F.col("engine_decision") == "NO-TRADE") & (F.coalesce("n_setups", F.lit(0)) > 0), "mechanization").when(F.col("engine_decision") == "NO-TRADE", "detector").otherwise("ambiguity")
    nothing = [F.lit(None).cast("int").alias("engine_rank"), F.lit(None).cast("long").alias("n_candidates")]
    direction = both.where("decision is not null").select(*scene, F.lit("direction").alias("dimension"), same.alias("agree"), *nothing, why.alias("category"))
    known = F.coalesce("has_range", F.lit(False))
    zones = both.where("zone is not null").select(*scene, F.lit("dealing_range").alias("dimension"), F.when(known, True).alias("agree"), *nothing, F.when(~known, "context").alias("category"))
    return found.unionByName(direction).unionByName(zones)


def disagreements(rows: DataFrame, by: list[str]) -> DataFrame:
    """Compared dimensions, agreements and disagreements of each category."""
    names = ["detector", "context", "ranking", "mechanization", "ambiguity"]
    wrong = ~F.coalesce("agree", F.lit(True))
    return rows.groupBy(*by, "dimension").agg(F.count("*").alias("n"), F.count_if("agree").alias("agreed"), *(F.count_if(wrong & (F.col("category") == c)).alias(c) for c in names))


#: Columns that tell what became of a candidate and may not be features.
OUTCOMES = {"result", "fill", "final", "realized", "mfe", "mae", "before_stop", "r1", "r2", "r3", "label", "end", "end_time"}


def classifiers(rows: DataFrame, numeric: list[str], categories: list[str], label: str, time: str, resolved: str, share: float = 0.7, trees: int = 60, depth: int = 8, least: int = 20, seed: int = 0) -> DataFrame:
    """A balanced logistic model and a random forest on the earlier ``share`` of time, judged on the rest.

    Rows learn if their outcome was ``resolved`` before the boundary, and are judged
    if they were decided (``time``) at or after it; those across are left out.
    Numbers lacking are the training rows' median, categories lacking are a level of
    their own and levels not seen in training have no cell.  Returns model, n_train,
    n_val, positive_rate, majority_accuracy, auc and accuracy at one half; no rows if
    the training rows have one class or nothing is judged.  A feature that tells the
    outcome is an error.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    leaked = OUTCOMES & {*numeric, *categories}
    if leaked:
        raise ValueError(f"outcomes among the features: {sorted(leaked)}")
    keep = [F.col(c).cast("double").alias(c) for c in numeric] + [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in categories]
    rows = written(rows.where(F.col(label).isin(0, 1)).select(*keep, F.col(label).cast("double").alias("y_"), F.col(time).alias("t_"), F.col(resolved).alias("r_")), "classified")
    edge = rows.agg(F.percentile(F.col("t_").cast("double"), share).alias("e")).first()["e"]
    schema = "model string, n_train long, n_val long, positive_rate double, majority_accuracy double, auc double, accuracy double"
    empty = rows.sparkSession.createDataFrame([], schema)
    if edge is None:
        return empty
    train, val = rows.where(F.col("r_").cast("double") < edge), rows.where(F.col("t_").cast("double") >= edge)
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("y_"), F.lit(0.0))).first()
    if not 0 < ones < n or val.isEmpty():
        return empty
    train = train.withColumn("weight_", F.when(F.col("y_") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))))
    front = [
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_n" for c in numeric]),
        StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_h" for c in categories], dropLast=True),
        VectorAssembler(inputCols=[*(f"{c}_n" for c in numeric), *(f"{c}_h" for c in categories)], outputCol="x_"),
    ]
    own = dict(labelCol="y_", weightCol="weight_", probabilityCol="p_", rawPredictionCol="raw_")
    models = {
        "logistic": Pipeline(stages=[*front, StandardScaler(inputCol="x_", outputCol="z_", withMean=True), LogisticRegression(featuresCol="z_", regParam=1.0 / n, maxIter=200, standardization=False, **own)]),
        "forest": Pipeline(stages=[*front, RandomForestClassifier(featuresCol="x_", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed, **own)]),
    }
    out = empty
    major = 1.0 if ones / n >= 0.5 else 0.0
    for name, pipeline in models.items():
        scored = pipeline.fit(train).transform(val).select("y_", vector_to_array("p_")[1].alias("p"), F.lit(name).alias("model"))
        totals = scored.groupBy("model").agg(F.lit(n).cast("long").alias("n_train"), F.count("*").alias("n_val"), F.avg("y_").alias("positive_rate"), F.avg((F.col("y_") == major).cast("double")).alias("majority_accuracy"), F.avg(((F.col("p") >= 0.5) == (F.col("y_") == 1)).cast("double")).alias("accuracy"))
        out = out.unionByName(totals.join(ranked_auc(scored), "model"))
    return out


def ranked_auc(scored: DataFrame) -> DataFrame:
    """Area under the curve of each model: scores are counted first, so only distinct ones are ranked."""
    counts = scored.groupBy("model", "p").agg(F.sum("y_").alias("ones"), F.sum(1 - F.col("y_")).alias("zeros"))
    below = F.coalesce(F.sum("zeros").over(Window.partitionBy("model").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return counts.withColumn("won", F.col("ones") * (below + F.col("zeros") / 2)).groupBy("model").agg(F.try_divide(F.sum("won"), F.sum("ones") * F.sum("zeros")).alias("auc"))
