"""Logistic paths, choice models and case deletion against plain numpy."""

import numpy as np
import pytest

from barspark.plans import logistic as L


def softmax(s):
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def plain_fit(x, y, k, alpha, weight):
    """Newton steps on penalized softmax; x has a leading 1 and two classes use one vector."""
    x, y, weight = np.asarray(x, float), np.asarray(y, int), np.asarray(weight, float)
    d, kinds = x.shape[1], np.unique(y)
    if len(kinds) == 2:
        own = (y == kinds[1]).astype(float)
        w = np.zeros(d)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            g = x.T @ (weight * (p - own)) + alpha * np.r_[0, w[1:]]
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + alpha * np.diag(np.r_[0, np.ones(d - 1)])
            w = w - np.linalg.solve(h, g)

        def predict(z):
            out, p = np.zeros((len(z), k)), 1 / (1 + np.exp(-z @ w))
            out[:, kinds[0]], out[:, kinds[1]] = 1 - p, p
            return out

        return predict
    w, mask = np.zeros((k, d)), np.tile(np.r_[0, np.ones(d - 1)], k)
    for _ in range(60):
        p = softmax(x @ w.T)
        g = ((p - np.eye(k)[y]) * weight[:, None]).T @ x
        h = np.zeros((k, d, k, d))
        for a in range(k):
            for b in range(k):
                h[a, :, b, :] = (x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        w = w - np.linalg.lstsq(h.reshape(k * d, k * d) + alpha * np.diag(mask), g.ravel() + alpha * mask * w.ravel(), rcond=None)[0].reshape(k, d)
    return lambda z: softmax(z @ w.T)


def even_weights(y):
    kinds, n = np.unique(y, return_counts=True)
    own = dict(zip(kinds, len(y) / (len(kinds) * n)))
    return np.array([own[v] for v in y])


def test_penalty_path(spark):
    rng = np.random.default_rng(3)
    data = []
    for symbol in ("a", "b"):
        x = rng.normal(size=(150, 2)) * [1, 30]
        s = x[:, 0] + x[:, 1] / 60 + rng.normal(size=150)
        y = np.digitize(s, [-0.8, 0.8]) if symbol == "a" else (s > 0) * 2
        data += [(symbol, i, float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(150)]
    rows = spark.createDataFrame(data, "symbol string, pos long, x1 double, x2 double, label int")
    got = L.penalty_path(rows, ["x1", "x2"], "label", [0, 1, 2], "symbol", "pos", folds=4).toPandas()
    assert len(got) == 2 * (150 - 38)
    for symbol, part in rows.toPandas().groupby("symbol"):
        x, y, pos = part[["x1", "x2"]].to_numpy(), part.label.to_numpy(), part.pos.to_numpy()
        fold = np.concatenate([np.full(150 // 4 + (f < 150 % 4), f) for f in range(4)])
        for test in (1, 2, 3):
            train = (fold < test) & (pos + 1 < pos[fold == test].min() - 6)
            mean, scale = x[train].mean(0), x[train].std(0)
            z = np.c_[np.ones(len(x)), (x - mean) / scale]
            tz, ty = z[train], y[train]
            cut = int(0.8 * len(ty))
            losses = []
            for c in L.GRID:
                p = plain_fit(tz[:cut], ty[:cut], 3, 1 / c, even_weights(ty[:cut]))(tz[cut:])
                losses.append(-np.log(np.maximum(p[np.arange(len(p)), ty[cut:]], 2.2e-16)).mean())
            best = L.GRID[int(np.argmin(losses))]
            want = plain_fit(tz, ty, 3, 1 / best, even_weights(ty))(z[fold == test])
            own = got[(got.symbol == symbol) & (got.fold == test)].sort_values("pos")
            assert (own.chosen == best).all()
            assert np.abs(np.stack(own.proba) - want).max() < 1e-6


def scenes(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        values = rng.normal(size=4)
        pick = int(values.argmax()) if values.max() > 0.5 else -1
        rows += [("k", s, c, float(values[c]) if (s, c) != (0, 0) else None, "up" if values[c] > 0 else None, None if s >= n - 3 else c == pick) for c in range(4)]
    return spark.createDataFrame(rows, "symbol string, scene long, candidate long, rr double, way string, chosen boolean")


def test_choice_ranker_against_plain(spark):
    rows = scenes(spark, 60)
    got = L.choice_ranker(rows, ["rr"], {"way": ["up", "down"]}, "symbol").toPandas().sort_values(["scene", "candidate"])
    plain = rows.toPandas().sort_values(["scene", "candidate"])
    z = np.c_[np.ones(len(plain)), plain.rr.fillna(0), plain.way == "up", np.zeros(len(plain)), plain.way.isna()].astype(float)
    known = plain.chosen.notna().to_numpy()
    y = plain.chosen[known].astype(int).to_numpy()
    p = plain_fit(z[known], y, 2, 1.0, even_weights(y))(z)[:, 1]
    assert np.abs(got.p.to_numpy() - p).max() < 6e-5
    assert not got.abstain.any()
    best = got.groupby("scene").p.transform("max")
    assert np.allclose(got.p_no_trade, 1 - best, atol=1e-9)


def test_choice_ranker_abstains(spark):
    got = L.choice_ranker(scenes(spark, 20), ["rr"], {"way": ["up", "down"]}, "symbol").toPandas()
    assert len(got) == 80 and got.abstain.all() and got.p.isna().all() and got.p_no_trade.isna().all()
    assert L.choice_ranker(scenes(spark, 20).where("false"), ["rr"], {"way": ["up"]}, "symbol").count() == 0


@pytest.mark.parametrize("n", [30, 400])
def test_case_deletion_equals_refits(spark, n):
    rng = np.random.default_rng(n)
    x = rng.uniform(size=(n, 3))
    y = (x @ [2, -1, 0.5] + rng.normal(size=n) * 0.7 > 0.9).astype(int)
    frame = spark.createDataFrame([("s", i, int(y[i]), *map(float, x[i])) for i in range(n)] + [("few", i, int(i == 0), 0.1, 0.2, 0.3) for i in range(4)], "symbol string, row_id long, label int, a double, b double, c double")
    got = L.case_deletion(frame, ["a", "b", "c"], "symbol").toPandas()
    assert len(got) == n + 4 and got[got.symbol == "few"].p.isna().all()
    own = got[got.symbol == "s"].sort_values("row_id")
    z = np.c_[np.ones(n), x]
    want = []
    for i in range(n):
        keep = np.arange(n) != i
        want.append(plain_fit(z[keep], y[keep], 2, 1.0, even_weights(y[keep]))(z[i : i + 1])[0, 1])
    assert np.abs(own.p.to_numpy() - np.array(want)).max() < 1e-6
    assert own.refitted.mean() < (1.01 if n == 30 else 0.6)
