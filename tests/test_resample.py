"""Resampling dealt over blocks is resampling of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.plans import resample as R


def plain_draws(x, draws, block, circular, seed=5):
    """Sums of n rows of a table of one or more columns, in blocks of time cut off at n."""
    n, rng = len(x), np.random.default_rng(seed)
    out = []
    for _ in range(draws):
        starts = rng.integers(0, n if circular else max(1, n - block + 1), -(-n // block))
        index = (starts[:, None] + np.arange(block)).ravel()[:n]
        out.append(x[index % n if circular else np.minimum(index, n - 1)].sum(0))
    return np.array(out)


def test_every_draw_has_all_its_samples_and_their_covariances(spark):
    """64 equal values in 20 or so blocks: counts of each sum to n and are multinomial."""
    n, draws = 64, 3000
    rows = spark.range(n).select(F.lit("k").alias("key_"), *(F.when(F.col("id") == i, 1.0).otherwise(0.0).alias(f"v{i}") for i in range(6)), F.lit(1.0).alias("one"), F.col("id").cast("double").alias("id_"), F.lit(n).alias("take_"))
    names = [f"v{i}" for i in range(6)] + ["one", "id_"]
    got = R.resampled_sums(rows, names, "take_", draws, 3, per_block=3).toPandas().sort_values("draw")
    assert got["draw"].tolist() == list(range(draws)) and (got["one"] == n).all()
    counts = got[[f"v{i}" for i in range(6)]].to_numpy()
    assert np.allclose(counts.mean(0), 1.0, atol=5 * np.sqrt(1 / draws))
    cov = np.cov(counts.T)
    assert np.allclose(np.diag(cov), 1 - 1 / n, atol=0.15) and np.allclose(cov - np.diag(np.diag(cov)), -1 / n, atol=0.1)
    assert got["id_"].std() == pytest.approx(np.sqrt(n) * np.arange(n).std(), rel=0.06)


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.lit("k").alias("key_"), (F.col("id") % 97).cast("double").alias("v"), F.lit(500).alias("take_"))
    a, b = (R.resampled_sums(r, ["v"], "take_", 50, 9, per_block=8).orderBy("draw").toPandas() for r in (rows, rows.repartition(7, "v")))
    assert np.allclose(a["v"], b["v"])


def test_a_value_of_most_rows_is_one_weighted_value(spark):
    rows = spark.range(300_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 3 < 2, 1.0).otherwise(-1.0).alias("v"))
    got = R.bootstrap_mean(rows, "v", "k", draws=400).first()
    assert got.n == 300_000 and got.mean == pytest.approx(1 / 3) and got.high - got.low == pytest.approx(2 * 1.645 * np.sqrt(8 / 9 / 300_000), rel=0.25)


@pytest.mark.parametrize("block,circular,n", [(1, True, 120), (5, True, 121), (5, False, 124), (7, True, 3), (7, False, 3), (5, False, 5)])
def test_means_of_blocks_against_plain_resampling(spark, block, circular, n):
    x = np.random.default_rng(n).normal(0.2, 1.0, n).cumsum() / 4
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, day int, v double")
    got = R.bootstrap_mean(frame, "v", "k", draws=3000, block=block, order="day", circular=circular, per_block=16).first()
    means = plain_draws(x, 6000, block, circular) / n
    width = max(np.quantile(means, 0.95) - np.quantile(means, 0.05), 1e-9)
    assert (got.n, got.mean) == (n, pytest.approx(x.mean()))
    assert abs(got.low - np.quantile(means, 0.05)) < 0.08 * width and abs(got.high - np.quantile(means, 0.95)) < 0.08 * width
    assert got.p == pytest.approx((means <= 0).mean(), abs=0.03)


def test_runs_around_the_end_and_the_run_that_remains(spark):
    frame = spark.createDataFrame([("k", i, float(10**i)) for i in range(5)], "key_ string, day int, v double")
    whole, last = R.run_sums(frame, ["v"], "day", 3, True)
    assert sorted(r.v for r in whole.collect()) == sorted([111.0, 1110.0, 11100.0, 11001.0, 10011.0])
    assert sorted(r.v for r in last.collect()) == sorted([11.0, 110.0, 1100.0, 11000.0, 10001.0])
    assert {r.take_ for r in whole.collect()} == {1} and {r.take_ for r in last.collect()} == {1}
    whole, last = R.run_sums(frame, ["v"], "day", 3, False)
    assert sorted(r.v for r in whole.collect()) == [111.0, 1110.0, 11100.0] and sorted(r.v for r in last.collect()) == [11.0, 110.0, 1100.0]


def test_sharpe_difference_against_plain_resampling(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0.1, 1, (90, 2)) + 1000.0
    frame = spark.createDataFrame([("a", i, float(u), float(v)) for i, (u, v) in enumerate(x)] + [("b", 0, 1.0, 2.0)] + [("c", i, 1.0, 1.0) for i in range(9)], "k string, day int, x double, y double")
    got = {r.key: r for r in R.bootstrap_sharpe_difference(frame, "x", "y", "k", "day", draws=2000, per_block=16).collect()}
    gen, n = np.random.default_rng(2), len(x)
    gaps = []
    for _ in range(4000):
        index = ((gen.integers(0, n, -(-n // 5))[:, None] + np.arange(5)).ravel()[:n]) % n
        s = x[index].mean(0) / x[index].std(0, ddof=1) * np.sqrt(252)
        gaps.append(s[0] - s[1])
    real = x.mean(0) / x.std(0, ddof=1) * np.sqrt(252)
    width = np.quantile(gaps, 0.975) - np.quantile(gaps, 0.025)
    assert got["a"].observed == pytest.approx(real[0] - real[1], rel=1e-6)
    assert abs(got["a"].low - np.quantile(gaps, 0.025)) < 0.08 * width and abs(got["a"].high - np.quantile(gaps, 0.975)) < 0.08 * width
    for flat in ("b", "c"):
        assert (got[flat].observed, got[flat].low, got[flat].high, got[flat].p) == (0.0, 0.0, 0.0, 1.0)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("a", 1, None), ("b", 1, 5.0), ("b", 1, 5.0)], "k string, day int, v double").withColumn("block_", F.lit(1)).withColumn("w_", F.lit("x"))
    got = {r.key: r for r in R.bootstrap_mean(frame, "v", "k", draws=50, block=2, order="day").collect()}
    assert set(got) == {None, "b"} and got[None].mean == 3.0 and (got["b"].n, got["b"].low, got["b"].high) == (2, 5.0, 5.0)
    empty = frame.where("false")
    assert R.bootstrap_mean(empty, "v", "k").count() == 0 and R.bootstrap_spread(empty, "v", "day", "k").count() == 0
    one = pd.DataFrame({"k": ["a"] * 4, "c": [0, 0, 0, 0], "v": [1.0, 2.0, 3.0, 4.0]})
    assert R.bootstrap_spread(spark.createDataFrame(one), "v", "c", "k").count() == 0
