"""Penalized logistic models of many runs at once, each Newton step one aggregation.

Rows are (run, label, weight, z): label a class from 0, z the features behind a
leading 1.  Tasks add up loss, slope and curvature of every (run, penalty) that
they meet in numpy and send one row a cell; Spark adds the cells, and the weights
are solved where their sums lie.  Rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.plans import models as M
from barspark.sources.shared import written

#: Inverse penalties that are tried.
GRID = [0.01, 0.1, 1.0, 10.0]
#: Runs whose sums a task holds before it sends them on.
HELD = 2000


def balanced(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``weight``: rows of the run by its classes and the rows of the row's own class."""
    own = rows.groupBy(*by, "label").agg(F.count("*").alias("own_"))
    run = Window.partitionBy(*by)
    weights = own.withColumn("weight", F.sum("own_").over(run) / (F.count(F.lit(1)).over(run) * F.col("own_"))).drop("own_")
    return rows.join(weights, [*by, "label"])


def shares(scores: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Probabilities of the classes of one run; one that the run never saw has none."""
    scores = np.where(seen, scores, -np.inf)
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _sums(k: int):
    free = range(k) if k > 2 else range(1, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        rows = lambda: pd.DataFrame([(*key, i, v) for key, cells in held.items() for i, v in enumerate(cells.tolist())], columns=["run", "alpha", "i", "v"])
        for part in batches:
            for key, own in part.groupby(["run", "alpha"], sort=False):
                x, m, y = np.stack(own["z"]), own["weight"].to_numpy(float), own["label"].to_numpy(int)
                d = x.shape[1]
                p = shares(x @ np.asarray(own["w"].iloc[0], float).reshape(k, d).T, np.asarray(own["seen"].iloc[0], bool))
                loss = -(m * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
                slope = [((p[:, a] - (y == a)) * m) @ x for a in free]
                curve = [(x * (m * p[:, a] * (float(a == b) - p[:, b]))[:, None]).T @ x for a in free for b in free]
                cells = np.concatenate([[loss], *slope, *(c.ravel() for c in curve)])
                held[key] = held[key] + cells if key in held else cells
            if len(held) > HELD:
                yield rows()
                held.clear()
        yield rows()

    return run


def _step(k: int):
    """One guarded Newton step: a loss that rose halves the last step instead."""
    free = np.arange(k) if k > 2 else np.array([1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                w, best, seen = np.array(r.w, float).reshape(k, -1), np.array(r.best, float).reshape(k, -1), np.asarray(r.seen, bool)
                d, f = w.shape[1], len(free)
                cells = np.asarray(r.cells, float)
                # two classes of many: the penalty of one vector, spread over two
                alpha = r.alpha * (2 if k > 2 and seen.sum() == 2 else 1)
                penalty = np.tile(np.append(0.0, np.full(d - 1, alpha)), f)
                flat = w[free].ravel()
                loss = cells[0] + 0.5 * float(penalty @ flat**2)
                if r.loss == r.loss and loss > r.loss + 1e-9 * (1 + abs(r.loss)):
                    new, kept = (w + best) / 2, (best, r.loss)
                else:
                    curve = cells[1 + f * d :].reshape(f, f, d, d).transpose(0, 2, 1, 3).reshape(f * d, f * d)
                    move = np.linalg.lstsq(curve + np.diag(penalty), cells[1 : 1 + f * d] + penalty * flat, rcond=None)[0]
                    new, kept = w.copy(), (w, loss)
                    new[free] = (flat - move).reshape(f, d)
                out.append((r.run, r.alpha, r.seen, new.ravel().tolist(), kept[0].ravel().tolist(), kept[1], float(np.abs(new - w).max())))
            yield pd.DataFrame(out, columns=["run", "alpha", "seen", "w", "best", "loss", "moved"])

    return run


_STATE = "run string, alpha double, seen array<boolean>, w array<double>, best array<double>, loss double, moved double"


def fit(rows: DataFrame, starts: DataFrame, k: int, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """Weights ``w`` (k vectors, one after the other) of each (run, alpha) of ``starts``.

    Softmax over k classes, of two the first has no vector; the penalty
    alpha / 2 times the squares spares the intercepts.  ``starts`` holds run,
    alpha and w to start from.  Ends when no weight moves by more than the
    tolerance.  A run without rows gives none.
    """
    rows = written(rows.select(F.col("run").cast("string").alias("run"), F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), "z"), "logistic")
    seen = rows.groupBy("run").agg(F.collect_set("label").alias("s_")).select("run", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.array_contains("s_", c)).alias("seen"))
    state = written(starts.join(seen, "run").select("run", F.col("alpha").cast("double").alias("alpha"), "seen", "w", F.col("w").alias("best"), F.lit(float("nan")).alias("loss"), F.lit(0.0).alias("moved")), "weights")
    for _ in range(steps):
        cells = rows.join(state.select("run", "alpha", "seen", "w"), "run").mapInPandas(_sums(k), "run string, alpha double, i int, v double")
        cells = cells.groupBy("run", "alpha", "i").agg(F.sum("v").alias("v")).groupBy("run", "alpha").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("cells"))
        state = written(state.drop("moved").join(cells, ["run", "alpha"]).mapInPandas(_step(k), _STATE), "weights")
        if (state.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return state.select("run", "alpha", "seen", "w")


def zeros(runs: DataFrame, k: int, d: int, alphas: list[float]) -> DataFrame:
    """Starting weights of every run for every penalty."""
    return runs.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"), F.array_repeat(F.lit(0.0), k * d).alias("w"))


def probabilities(k: int, d: int) -> Column:
    """Shares of the classes from ``w``, ``seen`` and ``z``."""
    scores = F.array(*(F.when(F.col("seen")[c], sum((F.col("w")[c * d + j] * F.col("z")[j] for j in range(d)), F.lit(0.0))) for c in range(k)))
    odds = F.transform(scores, lambda s: F.coalesce(F.exp(s - F.array_max(scores)), F.lit(0.0)))
    return F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, v: a + v))


def penalty_path(rows: DataFrame, features: list[str], label: str, classes: list[int], by: str, order: str, folds: int = 6, horizon: int = 1, embargo: int = 6, grid: list[float] = GRID) -> DataFrame:
    """Test rows of purged folds with ``proba`` (by class) and ``chosen``, the inverse penalty.

    Features are standardized by all training rows of a fold.  The last fifth of
    them (by ``order``) judges the grid, fitted on those before: all penalties
    advance in the same aggregations.  The first of least mean log loss is fitted
    anew on all training rows, from the weights that it had.  The first of the grid
    is taken where the inner part has ten rows or fewer, or one class, or where the
    last fifth has a class that the inner part lacks.  A fold whose training rows
    have one class gives no rows.
    """
    k, d = len(classes), len(features) + 1
    clean = M.numbered(rows.where(" and ".join(f"{c} is not null" for c in [*features, label])), order, by).withColumn("fold", M.even_fold(folds)).withColumn("entry_pos", F.col(order)).withColumn("exit_pos", F.col(order) + horizon)
    index = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    train = M.purged_pairs(clean, by, folds, embargo).withColumn("run", F.concat_ws(":", by, "test_fold")).drop("i", "n")
    train = M.numbered(train, order, "run").select("run", index.cast("int").alias("label"), *features, (F.col("i") < F.floor(0.8 * F.col("n"))).alias("inner"))
    spread = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    moments = train.groupBy("run").agg(F.array(*(F.avg(c) for c in features)).alias("mean"), F.array(*(spread(c) for c in features)).alias("scale"), F.count_distinct("label").alias("kinds"), F.count_if("inner").alias("n_inner"), F.count_distinct(F.when(F.col("inner"), F.col("label"))).alias("inner_kinds")).where("kinds >= 2")
    z = F.array(F.lit(1.0), *((F.col(c) - F.col("mean")[i]) / F.col("scale")[i] for i, c in enumerate(features)))
    train = written(train.join(moments, "run").select("run", "label", "inner", z.alias("z"), ((F.col("n_inner") > 10) & (F.col("inner_kinds") >= 2)).alias("judged")), "path")
    inner = balanced(train.where("inner and judged"), ["run"])
    tried = fit(inner, zeros(inner, k, d, [1 / c for c in grid]), k)
    held = train.where("judged and not inner").join(tried, "run").withColumn("p_", F.element_at(probabilities(k, d), F.col("label") + 1))
    loss = F.when(F.bool_and(F.element_at("seen", F.col("label") + 1)), F.avg(-F.ln(F.greatest("p_", F.lit(2.220446049250313e-16)))))
    losses = held.groupBy("run", "alpha").agg(loss.alias("loss"), F.first("w").alias("w")).where("loss is not null")
    best = losses.groupBy("run").agg(F.min_by(F.struct("alpha", "w"), F.struct("loss", -F.col("alpha"))).alias("b")).select("run", "b.*")
    starts = train.select("run").distinct().join(best, "run", "left").select("run", F.coalesce("alpha", F.lit(1 / grid[0])).alias("alpha"), F.coalesce("w", F.array_repeat(F.lit(0.0), k * d)).alias("w"))
    final = fit(balanced(train, ["run"]), starts, k)
    test = clean.where("fold > 0").withColumn("run", F.concat_ws(":", by, "fold")).join(moments.select("run", "mean", "scale"), "run").withColumn("z", z).join(final, "run")
    return test.withColumn("proba", probabilities(k, d)).withColumn("chosen", F.round(1 / F.col("alpha"), 9)).drop("run", "mean", "scale", "z", "w", "seen", "alpha", "i", "n", "entry_pos", "exit_pos")


def encoded(features: list[str], levels: dict[str, list[str]]) -> Column:
    """A leading 1, the features (null: 0) and a cell for each level of each category and for null; other levels have no cell."""
    cells = [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, own in levels.items() for v in own]
    nulls = [F.col(c).isNull().cast("double") for c in levels]
    return F.array(F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features), *cells, *nulls)


def choice_ranker(candidates: DataFrame, features: list[str], levels: dict[str, list[str]], by: str, least_scenes: int = 40, least_chosen: int = 15) -> DataFrame:
    """Probability ``p`` that each candidate of a scene is the one chosen, and ``p_no_trade`` of its scene.

    ``candidates`` hold ``scene`` and ``chosen`` (boolean; null in scenes without a
    label).  A model of each ``by`` learns from its labelled scenes, chosen
    candidates against others with balanced weights.  With fewer labelled scenes or
    choices than asked for it abstains: ``abstain`` is true and both probabilities
    are null.  ``p_no_trade`` is what the best candidate leaves.  A trained scene
    whose candidates have nulls counts them as zero.
    """
    d = 1 + len(features) + sum(len(v) + 1 for v in levels.values())
    known = candidates.where("chosen is not null").groupBy(by, "scene").agg(F.max(F.col("chosen").cast("int")).alias("any_"))
    counts = known.groupBy(by).agg(F.count("*").alias("scenes"), F.sum("any_").alias("choices"))
    rows = candidates.join(counts, by, "left").fillna(0, ["scenes", "choices"]).withColumn("abstain", (F.col("scenes") < least_scenes) | (F.col("choices") < least_chosen))
    rows = written(rows.withColumn("z", encoded(features, levels)).withColumn("run", F.col(by).cast("string")), "choices")
    train = balanced(rows.where("not abstain and chosen is not null").select("run", F.col("chosen").cast("int").alias("label"), "z"), ["run"])
    weights = fit(train, zeros(train, 2, d, [1.0]), 2)
    out = rows.join(weights, "run", "left").withColumn("p", F.when(~F.col("abstain") & F.col("w").isNotNull(), F.round(probabilities(2, d)[1], 4)))
    # the greatest p of a scene comes from an aggregation, which a hot scene does not gather
    most = out.groupBy(by, "scene").agg(F.round(1 - F.max("p"), 4).alias("p_no_trade"))
    return out.drop("run", "z", "w", "seen", "alpha").join(most, [by, "scene"])


def _moments(d: int):
    """Sums over rows of a class of the first four derivatives of the loss by the weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        rows = lambda: pd.DataFrame([(*key, i, v) for key, cells in held.items() for i, v in enumerate(cells.tolist())], columns=["run", "label", "i", "v"])
        for part in batches:
            for key, own in part.groupby(["run", "label"], sort=False):
                x, y = np.stack(own["z"]), own["label"].to_numpy(int)
                p = 1 / (1 + np.exp(-(x @ np.asarray(own["w"].iloc[0], float)[d:])))
                q = p * (1 - p)
                cells = [(p - y) @ x]
                product = x
                for term in (q, q * (1 - 2 * p), q * (1 - 6 * q)):
                    cells.append((product * term[:, None]).T @ x)
                    product = (product[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                flat = np.concatenate([[float(len(x))], *(c.ravel() for c in cells)])
                held[key] = held[key] + flat if key in held else flat
            if len(held) > HELD:
                yield rows()
                held.clear()
        yield rows()

    return run


def _deleted(d: int, alpha: float, near: float):
    """Weights without each row, from the expansions of both classes less the row's own slope."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                w, x, y = np.array(r.w, float)[d:], np.array(r.z, float), int(r.label)
                cells = [np.array(c, float) for c in (r.cells0, r.cells1)]
                n = np.array([cells[0][0], cells[1][0]])
                left = n - np.array([y == 0, y == 1])
                m = left.sum() / (2 * left)
                total = m[0] * cells[0][1:] + m[1] * cells[1][1:]
                g, h, t, u = (total[a:b].reshape((d,) * order) for order, (a, b) in enumerate(((0, d), (d, d + d**2), (d + d**2, d + d**2 + d**3), (d + d**2 + d**3, d + d**2 + d**3 + d**4)), 1))
                penalty, move = np.append(0.0, np.full(d - 1, alpha)), np.zeros(d)
                for _ in range(30):
                    p = 1 / (1 + np.exp(-(x @ (w + move))))
                    t1 = t @ move
                    u1 = u @ move @ move
                    slope = g + h @ move + t1 @ move / 2 + u1 @ move / 6 - m[y] * (p - y) * x + penalty * (w + move)
                    curve = h + t1 + u1 / 2 - m[y] * p * (1 - p) * np.outer(x, x) + np.diag(penalty)
                    step = np.linalg.lstsq(curve, slope, rcond=None)[0]
                    move = move - step
                    if not np.isfinite(move).all() or np.abs(step).max() < 1e-12:
                        break
                # the features' bound times the move bounds how far any row's score moves
                fine = bool(np.isfinite(move).all() and np.abs(step).max() < 1e-9 and np.abs(move) @ np.array(r.reach, float) < near)
                out.append((r.run, r.row_id, float(1 / (1 + np.exp(-(x @ (w + move))))) if fine else None, fine))
            yield pd.DataFrame(out, columns=["run", "row_id", "p", "fine"])

    return run


def case_deletion(rows: DataFrame, features: list[str], by: str, alpha: float = 1.0, near: float = 0.06) -> DataFrame:
    """Leave-one-out probability ``p`` of label 1 of each row, with balanced weights of the rows that are left.

    ``rows`` hold ``by``, ``row_id`` (unique within it), ``label`` 0 or 1 and
    features without nulls.  One pass adds up, by class, the derivatives of the loss
    up to the fourth at the weights of all rows; without a row the slope is that
    expansion less the row's own, solved to its zero.  Where no score can move by
    more than ``near`` the next term is below 1e-6.  Rows beyond that are refitted
    without the row (``refitted``): with deletions weighing about 1 / n, only runs
    of some hundred rows have them.  A ``by`` with fewer than two rows of a class
    gives nulls.
    """
    d = len(features) + 1
    z = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in features))
    base = written(rows.select(F.col(by).cast("string").alias("run"), F.col("row_id"), F.col("label").cast("int").alias("label"), z.alias("z")), "deletion")
    enough = base.groupBy("run").agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("least"), F.array(*(F.max(F.abs(F.col("z")[j])) for j in range(d))).alias("reach")).where("least >= 2")
    train = balanced(base.join(enough.select("run"), "run"), ["run"])
    weights = fit(train, zeros(train, 2, d, [alpha]), 2)
    cells = base.join(weights.select("run", "w"), "run").select("run", "label", "z", "w").mapInPandas(_moments(d), "run string, label int, i int, v double")
    cells = cells.groupBy("run", "label", "i").agg(F.sum("v").alias("v")).groupBy("run").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == c, F.struct("i", "v")))), lambda e: e["v"]).alias(f"cells{c}") for c in (0, 1)))
    model = weights.select("run", "w").join(cells, "run").join(enough.select("run", "reach"), "run")
    kind = dict(base.dtypes)["row_id"]
    near_ = written(base.join(model, "run").mapInPandas(_deleted(d, alpha, near), f"run string, row_id {kind}, p double, fine boolean"), "deleted")
    far = near_.where("not fine").select(F.col("run").alias("own"), F.col("row_id").alias("out"))
    name = F.concat_ws(":", "own", F.col("out").cast("string"))
    left = far.join(base, F.col("own") == F.col("run")).where("row_id <> out").select(name.alias("run"), "label", "z")
    starts = far.join(weights, F.col("own") == F.col("run")).select(name.alias("run"), "alpha", "w")
    again = fit(balanced(left, ["run"]), starts, 2)
    refitted = base.join(far, (F.col("own") == F.col("run")) & (F.col("out") == F.col("row_id"))).select(name.alias("run"), "own", "out", "z").join(again, "run").select(F.col("own").alias("run"), F.col("out").alias("row_id"), probabilities(2, d)[1].alias("q_"))
    scored = near_.join(refitted, ["run", "row_id"], "left").select("run", "row_id", F.coalesce("p", "q_").alias("p"), (~F.col("fine")).alias("refitted"))
    return rows.join(scored.withColumnRenamed("run", by), [by, "row_id"], "left")
