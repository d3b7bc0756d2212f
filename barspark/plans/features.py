"""Feature matrices of the three studies, as compositions of window operators.

All are causal by default: a row's features use rows up to it.  ``causal=False``
gives the two day-level features that earlier versions joined by calendar date,
which let a day's early rows see its opening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.session import eastern, minute_of_day
from barspark.operators import windows as V
from barspark.operators.windows import in_time

MARKET_STATE = [
    "atr_pct_of_price", "atr_regime_pctile", "vwap_distance_atr", "trend_slope_pct", "dist_to_swing_high_atr", "dist_to_swing_low_atr",
    "bars_since_sweep", "gap_atr_ratio", "overnight_imbalance_pctile", "hour_et", "weekday",
]
INTRADAY = ["or_position", "or_width", "session_phase", "momentum_6", "vwap_dev", "vol_regime", "overnight_gap", "return_since_open", "participation"]
VOLATILITY = ["ln_rv_6", "ln_rv_24", "ln_rv_session", "ln_rv_prev_session", "atr_ratio", "or_width", "session_phase", "participation", "abs_gap_atr", "efficiency_ratio"]


def _local(bars: DataFrame) -> DataFrame:
    return bars.withColumn("et", eastern(F.col("ts"))).withColumn("day", F.to_date("et")).withColumn("minute", minute_of_day(F.col("et")))


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def market_state(bars: DataFrame, causal: bool = True, lookback: int = 200, days: int = 20) -> DataFrame:
    """The eleven market-state features of bars with ``pos`` and confirmed swings ``ch`` and ``cl``."""
    frame = _local(bars).withColumn("tr", V.true_range()).withColumn("vwap", V.session_vwap())
    frame = V.smoothed(frame, {"atr": V.ema_spec("tr", 14), "ema50": V.ema_spec("close", 50)})
    gaps = frame.groupBy("symbol", "day").agg(F.min_by("open", F.when(F.col("minute") >= 570, F.col("ts"))).alias("rth_open"))
    prior = frame.where("minute < 960").groupBy("symbol", F.date_add("day", 1).alias("day")).agg(F.max_by("close", "ts").alias("prior_close"))
    night = frame.where("minute >= 960 or minute < 570").withColumn("day", F.when(F.col("minute") >= 960, F.date_add("day", 1)).otherwise(F.col("day")))
    imbalance = night.groupBy("symbol", "day").agg(F.abs(F.sum(F.col("volume") * F.signum(F.col("close") - F.col("open")))).alias("imbalance"))
    line = Window.partitionBy("symbol").orderBy("day").rowsBetween(1 - days, 0)
    values = F.collect_list("imbalance").over(line)
    now = F.col("imbalance")
    rank = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.when(x < now, 1.0).when(x == now, 0.5).otherwise(0.0)) + 0.5
    imbalance = imbalance.withColumn("imbalance_pctile", F.when(F.size(values) == days, rank / days)).drop("imbalance")
    frame = frame.join(gaps, ["symbol", "day"], "left").join(prior, ["symbol", "day"], "left").join(imbalance, ["symbol", "day"], "left")
    known = (F.col("minute") >= 570) if causal else F.lit(True)
    atr = _positive("atr")
    swept = ((F.col("high") > F.col("ch")) & (F.col("close") < F.col("ch"))) | ((F.col("low") < F.col("cl")) & (F.col("close") > F.col("cl")))
    return frame.withColumns({
        "atr_pct_of_price": F.col("atr") / F.col("close"), "atr_regime_pctile": V.percent_rank_within("atr", lookback), "vwap_distance_atr": (F.col("close") - F.col("vwap")) / atr,
        "trend_slope_pct": V.change_rate("ema50", 10), "dist_to_swing_high_atr": (F.col("ch") - F.col("close")) / atr, "dist_to_swing_low_atr": (F.col("close") - F.col("cl")) / atr,
        "bars_since_sweep": V.rows_since(swept).cast("double"), "gap_atr_ratio": F.when(known, (F.col("rth_open") - F.col("prior_close")) / atr), "overnight_imbalance_pctile": F.when(known, F.col("imbalance_pctile")),
        "hour_et": F.hour("et").cast("double"), "weekday": F.weekday("et").cast("double"),
    })


def _opening_range(causal: bool, minutes: tuple[int, int]) -> tuple[Column, Column]:
    day = Window.partitionBy("symbol", "day")
    inside = (F.col("minute") >= minutes[0]) & (F.col("minute") < minutes[1])
    high, low = F.max(F.when(inside, F.col("high"))).over(day), F.min(F.when(inside, F.col("low"))).over(day)
    done = F.col("minute") >= minutes[1]
    return (F.when(done, high), F.when(done, low)) if causal else (high, low)


def intraday(bars: DataFrame, causal: bool = True, opening: tuple[int, int] = (570, 660), days: int = 20) -> DataFrame:
    """The nine intraday features; the opening range is unknown before it ends unless ``causal`` is off."""
    frame = V.smoothed(_local(bars).withColumn("tr", V.true_range()), {"atr": V.ema_spec("tr", 14)})
    high, low = _opening_range(causal, opening)
    rth = (F.col("minute") >= 570) & (F.col("minute") < 960)
    so_far = Window.partitionBy("symbol", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    volume = F.sum(F.when(rth, F.col("volume"))).over(so_far)
    daily = frame.groupBy("symbol", "day").agg(F.avg("atr").alias("day_atr"), F.max_by("close", F.when(rth, F.col("ts"))).alias("rth_close"))
    before = Window.partitionBy("symbol").orderBy("day")
    spread = before.rowsBetween(-days, -1)
    daily = daily.withColumn("usual_atr", F.when(F.count("day_atr").over(spread) == days, F.percentile("day_atr", F.lit(0.5)).over(spread))).withColumn("prior_close", F.lag("rth_close").over(before))
    slot = Window.partitionBy("symbol", "minute").orderBy("ts").rowsBetween(-days, -1)
    usual = F.when(F.count(F.lit(1)).over(slot) == days, F.percentile("volume", F.lit(0.5)).over(slot))
    frame = frame.join(daily.drop("day_atr", "rth_close"), ["symbol", "day"], "left").withColumn("or_h", high).withColumn("or_l", low)
    first_open = F.first(F.when(rth, F.col("open")), ignorenulls=True).over(so_far)
    atr = _positive("atr")
    return frame.withColumns({
        "or_position": (F.col("close") - (F.col("or_h") + F.col("or_l")) / 2) / atr, "or_width": (F.col("or_h") - F.col("or_l")) / atr,
        "session_phase": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("minute") - 570) / 390)), "momentum_6": (F.col("close") - F.lag("close", 6).over(in_time())) / atr,
        "vwap_dev": (F.col("close") - F.sum(F.when(rth, typical)).over(so_far) / F.when(volume > 0, volume)) / atr, "vol_regime": F.col("atr") / _positive("usual_atr"),
        "overnight_gap": (first_open - F.col("prior_close")) / atr, "return_since_open": (F.col("close") - first_open) / atr, "participation": F.col("volume") / usual,
    })


def volatility(bars: DataFrame, opening: tuple[int, int] = (570, 660), days: int = 20) -> DataFrame:
    """The ten volatility features over regular trading hours, sums kept inside a session."""
    frame = _local(bars).where((F.col("minute") >= 570) & (F.col("minute") < 960))
    day = Window.partitionBy("symbol", "day").orderBy("ts")
    frame = frame.withColumn("sq", F.pow(V.log_return(day), 2)).withColumn("step", F.abs(F.col("close") - F.lag("close").over(day))).withColumn("tr", V.true_range(F.lag("close").over(day)))
    frame = V.smoothed(frame, {"atr": V.wilder_spec("tr", 14)})
    daily = frame.groupBy("symbol", "day").agg(F.sum("sq").alias("rv_day"), F.avg("atr").alias("day_atr"), F.min_by("open", "ts").alias("day_open"), F.max_by("close", "ts").alias("day_close"))
    before = Window.partitionBy("symbol").orderBy("day")
    spread = before.rowsBetween(-days, -1)
    daily = daily.select("symbol", "day", F.lag("rv_day").over(before).alias("rv_prev"), F.abs(F.col("day_open") - F.lag("day_close").over(before)).alias("gap"), F.when(F.count("day_atr").over(spread) == days, F.percentile("day_atr", F.lit(0.5)).over(spread)).alias("usual_atr"))
    frame = frame.join(daily, ["symbol", "day"], "left")
    high, low = _opening_range(True, opening)
    frame = frame.withColumn("or_h", high).withColumn("or_l", low)
    slot = Window.partitionBy("symbol", "minute").orderBy("ts").rowsBetween(-days, -1)
    usual = F.when(F.count(F.lit(1)).over(slot) == days, F.percentile("volume", F.lit(0.5)).over(slot))
    ln = lambda c: F.when(c > 0, F.ln(c))
    sq, atr = F.col("sq"), _positive("atr")
    path = V.trailing_sum(F.col("step"), 12, day)
    return frame.withColumns({
        "ln_rv_6": ln(V.trailing_sum(sq, 6, day)), "ln_rv_24": ln(V.trailing_sum(sq, 24, day)), "ln_rv_session": ln(F.sum(sq).over(day.rowsBetween(Window.unboundedPreceding, 0))), "ln_rv_prev_session": ln(F.col("rv_prev")),
        "atr_ratio": F.col("atr") / _positive("usual_atr"), "or_width": (F.col("or_h") - F.col("or_l")) / atr, "session_phase": (F.col("minute") - 570) / 390, "participation": F.col("volume") / usual,
        "abs_gap_atr": F.col("gap") / atr, "efficiency_ratio": F.when(path > 0, F.abs(F.col("close") - F.lag("close", 12).over(day)) / path),
    })
