"""Marks against candidates by a plain loop, and classifiers on rows with and without a signal."""

import numpy as np
import pytest

from barspark.plans import research as R


def plain(candidates, mark, engine):
    """What one scene's dimensions come to."""
    out = {}
    for dimension in ("manipulation", "shift", "gap"):
        level, way = mark[dimension], mark["manipulation_way"] if dimension == "manipulation" else None
        if level is None:
            continue
        own = sorted((c for c in candidates if c["dimension"] == dimension), key=lambda c: c["rank"])
        fits = [c for c in own if way is None or c["way"] == way]
        best = min(fits, key=lambda c: abs(c["price"] - level), default=None)
        rank = best["rank"] if best and abs(best["price"] - level) <= max(abs(level) * 0.0025, 1e-9) else None
        conflict = way is not None and bool(own) and own[0]["way"] != way
        why = None if rank == 1 else "detector" if rank is None else "context" if conflict else "ranking"
        out[dimension] = (rank == 1, rank, len(own), why)
    if mark["decision"] is not None:
        took, wanted = engine["engine_decision"], mark["decision"]
        same = took.replace("-", "_") == wanted
        why = None if same else "context" if took != "NO-TRADE" and wanted != "NO_TRADE" else ("mechanization" if engine["n_setups"] else "detector") if took == "NO-TRADE" else "ambiguity"
        out["direction"] = (same, None, None, why)
    if mark["zone"] is not None:
        out["dealing_range"] = (True if engine["has_range"] else None, None, None, None if engine["has_range"] else "context")
    return out


def test_compared_against_a_loop(spark):
    rng = np.random.default_rng(11)
    pick = lambda *v: v[rng.integers(len(v))]
    candidates, marks, engine = [], [], []
    for s in range(120):
        for dimension in ("manipulation", "shift", "gap"):
            for rank in range(1, int(rng.integers(0, 5)) + 1):
                candidates.append(dict(scene=s, dimension=dimension, way=pick(-1, 1), price=float(pick(100.0, 100.1, 99.9, 101.0)), rank=rank))
        marks.append(dict(scene=s, decision=pick("LONG", "SHORT", "NO_TRADE", None), manipulation_way=pick(-1, 1, None), manipulation=pick(100.0, 101.0, None), shift=pick(100.05, 101.0, None), gap=pick(100.0, 55.0, 0.0, None), zone=pick("premium", None)))
        engine.append(dict(scene=s, engine_decision=pick("LONG", "SHORT", "NO-TRADE"), n_setups=int(rng.integers(0, 2)), has_range=pick(True, False)))
    frame = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    c = frame(candidates, "scene int, dimension string, way int, price double, rank int")
    m = frame(marks, "scene int, decision string, manipulation_way int, manipulation double, shift double, gap double, zone string")
    e = frame(engine, "scene int, engine_decision string, n_setups int, has_range boolean")
    got = {(r.scene, r.dimension): (r.agree, r.engine_rank, r.n_candidates, r.category) for r in R.compared(c, m, e, ["scene"]).collect()}
    want = {(s, k): v for s in range(120) for k, v in plain([x for x in candidates if x["scene"] == s], marks[s], engine[s]).items()}
    assert got == want
    assert {v[3] for v in want.values()} == {None, "detector", "context", "ranking", "mechanization", "ambiguity"}
    assert R.compared(c, m.where("false"), e, ["scene"]).count() == 0
    # without candidates nothing is detected, without an engine's row there is no trade
    assert {r.category for r in R.compared(c.where("false"), m.where("shift is not null"), e.where("false"), ["scene"]).where("dimension = 'shift'").collect()} == {"detector"}


def outcomes(spark, signal, n=900):
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    y = (signal * x + rng.logistic(size=n) > 0).astype(int)
    kind = rng.choice(["a", "b"], n)
    rows = [(float(x[i]) if i % 50 else None, str(kind[i]) if i % 40 else None, int(y[i]), i, i + 5) for i in range(n)]
    return spark.createDataFrame(rows, "x double, kind string, label int, decision long, final long")


def test_classifiers_find_a_signal_and_only_that(spark):
    args = (["x"], ["kind"], "label", "decision", "final")
    strong = {r.model: r for r in R.classifiers(outcomes(spark, 2.0), *args, trees=20).collect()}
    none = {r.model: r for r in R.classifiers(outcomes(spark, 0.0), *args, trees=20).collect()}
    for model in ("logistic", "forest"):
        assert strong[model].auc > 0.8 and abs(none[model].auc - 0.5) < 0.12
        # rows whose outcome was not known at the boundary neither learn nor are judged
        assert strong[model].n_val == 270 and strong[model].n_train == 625
        assert abs(strong[model].majority_accuracy - max(strong[model].positive_rate, 1 - strong[model].positive_rate)) < 1e-9 or strong[model].majority_accuracy < 0.5


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(7)
    p, y = rng.integers(0, 6, 200) / 5, rng.integers(0, 2, 200).astype(float)
    frame = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(p, y)], "model string, p double, y_ double")
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(R.ranked_auc(frame).first()["auc"] - np.mean(pairs)) < 1e-12


def test_classifiers_refuse_outcomes_and_thin_rows(spark):
    with pytest.raises(ValueError, match="realized"):
        R.classifiers(outcomes(spark, 1.0), ["x", "realized"], ["kind"], "label", "decision", "final")
    args = (["x"], ["kind"], "label", "decision", "final")
    assert R.classifiers(outcomes(spark, 1.0).where("false"), *args).count() == 0
    assert R.classifiers(outcomes(spark, 1.0).where("label = 1"), *args).count() == 0
