"""Bundles of all symbols against plain fits, and what they do with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.plans import bundles as B
from barspark.sources import stores

FEATURES = ["f", "g"]


def plain_fit(x, y, classes, penalty, steps=4000):
    """Softmax regression of the classes on standardized features by gradient steps."""
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)]
    w, hot = np.zeros((len(classes), z.shape[1])), (y[:, None] == classes).astype(float)
    for _ in range(steps):
        s = z @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (p - hot).T @ z + penalty * np.c_[np.zeros(len(classes)), w[:, 1:]]
        w -= slope * 2 / len(x)
    return lambda q: (lambda o: o / o.sum(1, keepdims=True))(np.exp(np.c_[np.ones(len(q)), (q - x.mean(0)) / x.std(0)] @ w.T))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for symbol, kinds in (("a", [0, 1, 2, 3, 4]), ("b", [1, 3])):
        for i in range(300):
            label = int(rng.choice(kinds))
            rows.append((symbol, i, i + 5, 2.0, float(label + rng.normal(0, 2)) * 10, float(rng.normal(5, 3)), label, float(label - 2 + rng.normal(0, 0.1))))
    rows += [("c", i, i + 5, 2.0, 1.0 * i, 1.0, 2, 0.0) for i in range(20)]
    rows += [("a", 10, 15, 2.0, None, 1.0, 0, -9.0), ("a", 11, 16, 2.0, 1.0, 1.0, None, None)]
    return spark.createDataFrame(rows, "symbol string, ts int, known_at int, atr double, f double, g double, label int, ahead double")


@pytest.mark.parametrize("settled", [False, True])
def test_stored_bundles_score_as_plain_fits(spark, table, tmp_path, settled):
    stores.save_bundle(B.build(table, FEATURES, F.lit(199), 6.0, 2.0, settled=settled), f"{tmp_path}/{settled}", horizon="5")
    bundle, facts = stores.load_bundle(spark, f"{tmp_path}/{settled}")
    held = {r.symbol: r for r in bundle.collect()}
    assert set(held) == {"a", "b"} and facts == {"horizon": "5"}  # one class is no model
    got = B.score(table.where("ts > 199"), bundle, FEATURES).orderBy("ts").toPandas()
    whole = table.toPandas().dropna()
    for symbol, classes in (("a", [0, 1, 2, 3, 4]), ("b", [1, 3])):
        own = whole[(whole.symbol == symbol) & ((whole.known_at if settled else whole.ts) <= 199)]
        assert held[symbol].n_train == len(own) == (195 if settled else 200)
        means = [own.ahead[own.label == c].mean() if (own.label == c).any() else 0.0 for c in range(5)]
        assert np.allclose(held[symbol].returns, means)
        ask = got[got.symbol == symbol]
        # two classes have one vector v with penalty 1; as two vectors, v / 2 and -v / 2, that is a penalty of 2
        want = plain_fit(own[FEATURES].to_numpy(float), own.label.to_numpy(int), np.array(classes), 1.0 if len(classes) > 2 else 2.0)(ask[FEATURES].to_numpy(float))
        proba = np.stack(ask.proba.to_numpy()).astype(float)
        assert np.allclose(proba[:, classes], want, atol=2e-3) and np.allclose(proba.sum(1), 1)
        assert np.allclose(ask.ev, proba @ np.array(means)) and (ask.cost_hurdle == 1.5).all()


def test_odd_rows(spark, table):
    bundle = B.build(table, FEATURES, F.lit(199), 6.0, 2.0)
    odd = spark.createDataFrame([("a", 0, 2.0, None, 1.0, "x"), ("a", 1, 0.0, 3.0, 1.0, "x"), ("z", 1, 1.0, 3.0, 1.0, "x")], "symbol string, ts int, atr double, f double, g double, w_ string")
    got = {(r.symbol, r.ts): r for r in B.score(odd, bundle, FEATURES).collect()}
    assert set(got) == {("a", 0), ("a", 1)} and got["a", 0].proba is None and got["a", 0].ev is None and got["a", 0].cost_hurdle is None
    assert got["a", 1].ev is not None and got["a", 1].cost_hurdle is None
    assert B.build(table.where("false"), FEATURES, F.lit(199), 6.0, 2.0).count() == 0
    with pytest.raises(Exception, match="other features"):
        B.score(odd, bundle, ["g", "f"]).collect()


def test_the_causal_bundle_lacks_the_leaky_features():
    assert len(B.CAUSAL) == 9 and not set(B.LEAKY) & set(B.CAUSAL)
