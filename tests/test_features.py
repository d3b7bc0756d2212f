"""Feature matrices against pandas, bar by bar, on the smallest tables."""

import numpy as np
import pandas as pd
import pytest

from barspark import catalog
from barspark.catalog import bars as catalog_bars

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hourly(spark):
    frame = catalog_bars.hourly(spark, SMALL).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    frame["et"] = frame.ts.dt.tz_localize("UTC").dt.tz_convert("America/New_York").dt.tz_localize(None)
    frame["day"], frame["minute"] = frame.et.dt.normalize(), frame.et.dt.hour * 60 + frame.et.dt.minute
    return frame


def by_symbol(frame, f):
    return pd.concat([f(part.copy().reset_index(drop=True)) for _, part in frame.groupby("symbol", sort=True)], ignore_index=True)


def true_range(part, previous):
    return pd.concat([(part.high - part.low).abs(), (part.high - previous).abs(), (part.low - previous).abs()], axis=1).max(axis=1)


def positive(x):
    return x.where(x > 0)


def percent_rank(series, n):
    return series.rolling(n).apply(lambda v: ((v < v[-1]).sum() + ((v == v[-1]).sum() + 1) / 2) / n, raw=True)


def compare(spark, name, expected):
    got = catalog.QUERIES[name](spark, SMALL).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    expected = expected.sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(got) == len(expected)
    for c in got.columns.difference(["symbol", "ts"]):
        a, b = got[c].to_numpy(float), expected[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-7, atol=1.1e-6), c


def test_market_state(spark, hourly):
    def features(p):
        p["atr"] = true_range(p, p.close.shift()).ewm(span=14, adjust=False, min_periods=14).mean()
        slow = p.close.ewm(span=50, adjust=False, min_periods=50).mean()
        tp = (p.high + p.low + p.close) / 3
        vwap = (tp * p.volume).groupby(p.day).cumsum() / p.volume.groupby(p.day).cumsum()
        n = len(p)
        swing = lambda x, best: pd.Series([x[i] == best(x[i - 2 : i + 3]) if 2 <= i < n - 2 else False for i in range(n)])
        high, low = p.high.to_numpy(), p.low.to_numpy()
        ch = p.high.where(swing(high, np.max)).shift(2).ffill()
        cl = p.low.where(swing(low, np.min)).shift(2).ffill()
        swept = ((p.high > ch) & (p.close < ch)) | ((p.low < cl) & (p.close > cl))
        last = pd.Series(np.where(swept, np.arange(n), np.nan)).ffill().fillna(-1)
        opening = p[p.minute >= 570].groupby("day").open.first()
        prior = p[p.minute < 960].groupby("day").close.last()
        prior.index = prior.index + pd.Timedelta(days=1)
        night = p[(p.minute >= 960) | (p.minute < 570)].copy()
        night["key"] = night.day + pd.to_timedelta((night.minute >= 960).astype(int), unit="D")
        size = (night.volume * np.sign(night.close - night.open)).groupby(night.key).sum().abs()
        rank = percent_rank(size, 20)
        known = p.minute >= 570
        a = positive(p.atr)
        return pd.DataFrame({
            "symbol": p.symbol, "ts": (p.ts - pd.Timestamp(0)) // pd.Timedelta(seconds=1), "atr_pct_of_price": p.atr / p.close, "atr_regime_pctile": percent_rank(p.atr, 200), "vwap_distance_atr": (p.close - vwap) / a,
            "trend_slope_pct": (slow - slow.shift(10)) / slow.shift(10), "dist_to_swing_high_atr": (ch - p.close) / a, "dist_to_swing_low_atr": (p.close - cl) / a, "bars_since_sweep": np.arange(n) - last,
            "gap_atr_ratio": ((p.day.map(opening) - p.day.map(prior)) / a).where(known), "overnight_imbalance_pctile": p.day.map(rank).where(known), "hour_et": p.et.dt.hour, "weekday": p.et.dt.weekday,
        })

    compare(spark, "d05_market_state_features", by_symbol(hourly, features))


def test_intraday(spark, hourly):
    def features(p):
        p["atr"] = true_range(p, p.close.shift()).ewm(span=14, adjust=False, min_periods=14).mean()
        rth = (p.minute >= 570) & (p.minute < 960)
        first = p[(p.minute >= 570) & (p.minute < 660)].groupby("day")
        done = p.minute >= 660
        oh, ol = p.day.map(first.high.max()).where(done), p.day.map(first.low.min()).where(done)
        tp = ((p.high + p.low + p.close) / 3 * p.volume).where(rth, 0).groupby(p.day).cumsum()
        volume = p.volume.where(rth, 0).groupby(p.day).cumsum()
        daily = p.groupby("day").atr.mean()
        usual = daily.rolling(20).median().shift()
        close = p[rth].groupby("day").close.last().reindex(daily.index).shift()
        start = p.open.where(rth).groupby(p.day).ffill()
        opened = p[rth].groupby("day").open.first()
        start = p.day.map(opened).where(start.notna())
        participation = p.volume / p.groupby("minute").volume.transform(lambda v: v.rolling(20).median().shift())
        a = positive(p.atr)
        return pd.DataFrame({
            "symbol": p.symbol, "ts": (p.ts - pd.Timestamp(0)) // pd.Timedelta(seconds=1), "or_position": (p.close - (oh + ol) / 2) / a, "or_width": (oh - ol) / a, "session_phase": ((p.minute - 570) / 390).clip(0, 1),
            "momentum_6": (p.close - p.close.shift(6)) / a, "vwap_dev": (p.close - tp / positive(volume)) / a, "vol_regime": p.atr / p.day.map(positive(usual)), "overnight_gap": (start - p.day.map(close)) / a,
            "return_since_open": (p.close - start) / a, "participation": participation,
        })

    compare(spark, "d06_intraday_features", by_symbol(hourly, features))


def test_volatility(spark, hourly):
    def features(p):
        p = p[(p.minute >= 570) & (p.minute < 960)].reset_index(drop=True)
        day = p.groupby("day")
        previous = day.close.shift()
        sq = (np.log(p.close) - np.log(previous)) ** 2
        step = (p.close - previous).abs()
        p["atr"] = true_range(p, previous).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        total = sq.groupby(p.day).sum(min_count=1)
        daily = p.groupby("day").atr.mean()
        usual = daily.rolling(20).median().shift()
        gap = (day.open.first() - day.close.last().shift()).abs()
        first = p[p.minute < 660].groupby("day")
        done = p.minute >= 660
        oh, ol = p.day.map(first.high.max()).where(done), p.day.map(first.low.min()).where(done)
        inside = lambda x, n: x.groupby(p.day).transform(lambda v: v.rolling(n).sum())
        ln = lambda x: np.log(x.where(x > 0))
        path = inside(step, 12)
        a = positive(p.atr)
        return pd.DataFrame({
            "symbol": p.symbol, "ts": (p.ts - pd.Timestamp(0)) // pd.Timedelta(seconds=1), "ln_rv_6": ln(inside(sq, 6)), "ln_rv_24": ln(inside(sq, 24)), "ln_rv_session": ln(sq.groupby(p.day).transform(lambda v: v.fillna(0).cumsum())),
            "ln_rv_prev_session": ln(p.day.map(total.shift())), "atr_ratio": p.atr / p.day.map(positive(usual)), "or_width": (oh - ol) / a, "session_phase": (p.minute - 570) / 390,
            "participation": p.volume / p.groupby("minute").volume.transform(lambda v: v.rolling(20).median().shift()), "abs_gap_atr": p.day.map(gap) / a, "efficiency_ratio": (p.close - p.groupby("day").close.shift(12)).abs() / positive(path),
        })

    compare(spark, "d07_volatility_features", by_symbol(hourly, features))
