"""Walk-forward models and resampling against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from barspark.plans import models as M
from barspark.plans import resample as R
from barspark.plans import stats as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for symbol in ("a", "b"):
        x = rng.normal(size=(240, 2))
        y = 0.4 * x[:, 0] - 0.2 * x[:, 1] + 0.3 * rng.normal(size=240)
        data += [(symbol, i, float(x[i, 0]), float(x[i, 1]), float(y[i]), float(math.exp(y[i])), int(np.digitize(y[i], [-0.3, 0.3]))) for i in range(240)]
    return spark.createDataFrame(data, "symbol string, pos long, x1 double, x2 double, y double, v double, label int")


def even_folds(n, k):
    return np.concatenate([np.full(n // k + (f < n % k), f) for f in range(k)])


def purged(pos, fold, test, embargo):
    return (fold < test) & (pos + 1 < pos[fold == test].min() - embargo)


def ridge(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / scale
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - b @ mean, b


def test_ridge_walk_forward(rows):
    got = M.ridge_walk_forward(rows, ["x1", "x2"], "y", "v", "symbol", "pos").toPandas()
    plain = rows.toPandas()
    for symbol, part in plain.groupby("symbol"):
        x, y, v, pos = part[["x1", "x2"]].to_numpy(), part.y.to_numpy(), part.v.to_numpy(), part.pos.to_numpy()
        fold = even_folds(len(y), 4)
        for test in (1, 2, 3):
            train = purged(pos, fold, test, 6)
            tx, ty, tv, tp = x[train], y[train], v[train], pos[train]
            inner = even_folds(len(ty), 6)
            best = None
            for alpha in M.ALPHAS:
                mu = np.full(len(ty), np.nan)
                for f in range(1, 6):
                    own = purged(tp, inner, f, 6)
                    a, b = ridge(tx[own], ty[own], alpha)
                    mu[inner == f] = a + tx[inner == f] @ b
                ok = ~np.isnan(mu)
                smear = np.exp(ty[ok] - mu[ok]).mean()
                ratio = tv[ok] / (smear * np.exp(mu[ok]))
                loss = (ratio - np.log(ratio) - 1).mean()
                if best is None or loss < best[0] - 1e-12:
                    best = loss, alpha, smear
            own = got[(got.symbol == symbol) & (got.fold == test)].sort_values("pos")
            assert set(own.alpha) == {best[1]} and own.smear.iloc[0] == pytest.approx(best[2])
            a, b = ridge(tx, ty, best[1])
            assert own.forecast.to_numpy() == pytest.approx(best[2] * np.exp(a + x[fold == test] @ b))


def test_multinomial_walk_forward(rows):
    got = M.multinomial_walk_forward(rows, ["x1", "x2"], "label", [0, 1, 2], "symbol", "pos", folds=3).toPandas()
    plain = rows.toPandas()
    part = plain[plain.symbol == "a"]
    x, label = part[["x1", "x2"]].to_numpy(), part.label.to_numpy()
    edges = [int(48 + (240 - 48) * k / 3) for k in range(4)]
    for fold in range(3):
        tx, ty = x[: edges[fold]], label[: edges[fold]]
        mean, scale = tx.mean(0), tx.std(0)
        z = np.hstack([np.ones((len(tx), 1)), (tx - mean) / scale])
        hot = np.eye(3)[ty]
        w = np.zeros((3, 3))
        for _ in range(20000):  # gradient steps without any haste
            s = z @ w.T
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= 0.004 * ((p - hot).T @ z + w * np.array([1e-6, 1.0, 1.0]))
        own = got[(got.symbol == "a") & (got.test_fold == fold)].sort_values("pos")
        s = np.hstack([np.ones((len(own), 1)), (x[edges[fold] : edges[fold + 1]] - mean) / scale]) @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        assert np.allclose(np.stack(own.proba), p / p.sum(1, keepdims=True), atol=1e-4)
        assert np.allclose(own.prior.iloc[0], np.bincount(ty, minlength=3) / len(ty))


def test_bootstraps_cover_the_mean(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(0.3, 1.0, 200)
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)] + [("b", 0, -1.0)], "k string, day int, v double")
    for block, circular in ((1, True), (5, True), (5, False)):
        got = {r.key: r for r in R.bootstrap_mean(frame, "v", "k", block=block, order="day", circular=circular).collect()}
        r = got["a"]
        assert r.mean == pytest.approx(values.mean()) and r.low < r.mean < r.high
        assert r.high - r.low == pytest.approx(2 * 1.645 * values.std() / math.sqrt(200), rel=0.35)
        assert (got["b"].low, got["b"].high, got["b"].p) == (-1.0, -1.0, 1.0)


def test_paired_sharpe_and_decile_spread(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, 300)
    frame = spark.createDataFrame([("a", i, float(b + 0.3), float(b)) for i, b in enumerate(base)], "k string, day int, x double, y double")
    r = R.bootstrap_sharpe_difference(frame, "x", "y", "k", "day").first()
    assert r.observed == pytest.approx(0.3 / base.std(ddof=1) * math.sqrt(252)) and r.low < r.observed < r.high and r.p < 0.01
    cells = spark.createDataFrame([("a", c, float(c + rng.normal())) for c in range(10) for _ in range(60)], "k string, cell int, v double")
    spread = R.bootstrap_spread(cells, "v", "cell", "k").first()
    assert spread.mean == pytest.approx(9.0, abs=0.5) and spread.low < spread.mean < spread.high


def test_deflated_best_is_lower_than_the_single_probability(spark):
    rng = np.random.default_rng(3)
    data = [(f"s{k}", i, float(rng.normal(0.1 * (k == 0), 1))) for k in range(6) for i in range(250)]
    got = {r.k: r for r in S.deflated_best(spark.createDataFrame(data, "k string, day int, v double"), ["k"], "v").collect()}
    series = pd.DataFrame(data, columns=["k", "day", "v"]).groupby("k").v
    assert got["s0"].sharpe == pytest.approx(series.mean()["s0"] / series.std()["s0"])
    assert got["s0"].p < S.deflated_sharpe(got["s0"].sharpe, 250, 0.0, 3.0, 1, 0.0)
