"""Scalar rules as columns: candles, levels, risk, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def body() -> Column:
    return F.abs(_c("close") - _c("open"))


def lower_wick() -> Column:
    return F.least("close", "open") - _c("low")


def upper_wick() -> Column:
    return _c("high") - F.greatest("close", "open")


def engulfs_up(po: Column, pc: Column) -> Column:
    return (pc < po) & (_c("close") > _c("open")) & (_c("close") >= po) & (_c("open") <= pc)


def engulfs_down(po: Column, pc: Column) -> Column:
    return (pc > po) & (_c("close") < _c("open")) & (_c("close") <= po) & (_c("open") >= pc)


def hammer(wick: float = 2.0, other: float = 0.33) -> Column:
    return (body() > 0) & (lower_wick() >= wick * body()) & (upper_wick() <= other * body())


def shooting_star(wick: float = 2.0, other: float = 0.33) -> Column:
    return (body() > 0) & (upper_wick() >= wick * body()) & (lower_wick() <= other * body())


def doji(most: float = 0.1) -> Column:
    span = _c("high") - _c("low")
    return (span > 0) & (body() <= most * span)


def fib_level(start: Column, end: Column, ratio: float) -> Column:
    """Price after retracing ``ratio`` of the leg from start to end."""
    return end - (end - start) * ratio


def between_levels(price: Column, a: Column, b: Column, slack: Column | float = 0.0) -> Column:
    return (price >= F.least(a, b) - slack) & (price <= F.greatest(a, b) + slack)


def stop_price(is_long: Column, level: Column, tick: float, ticks: int) -> Column:
    return F.when(is_long, level - tick * ticks).otherwise(level + tick * ticks)


def position_size(equity: Column, entry: Column, stop: Column, point_value: float, share: float, most: int) -> Column:
    per_contract = F.abs(entry - stop) * point_value
    return F.when(per_contract > 0, F.least(F.floor(equity * share / per_contract), F.lit(most))).otherwise(0).cast("long")


def reward_risk(entry: Column, stop: Column, target: Column) -> Column:
    risk = F.abs(entry - stop)
    return F.when(risk > 0, F.abs(target - entry) / risk).otherwise(0.0)


def slipped(price: Column, is_long: Column, is_entry: bool, adverse: float) -> Column:
    return F.when(is_long == F.lit(is_entry), price + adverse).otherwise(price - adverse)


def bucket(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value: left-closed bins with open ends."""
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


def percentile_bucket(p: Column, names: list[str]) -> Column:
    return F.when(p.isNull(), "unknown").otherwise(F.element_at(F.array(*map(F.lit, names)), F.least(F.lit(len(names)), F.floor(p * len(names)).cast("int") + 1)))


def garman_klass() -> Column:
    """Variance of a bar from its range and body; null where a price is not positive."""
    ratio = lambda a, b: F.ln(_c(a)) - F.ln(_c(b))
    value = 0.5 * F.pow(ratio("high", "low"), 2) - (2 * math.log(2) - 1) * F.pow(ratio("close", "open"), 2)
    return F.when((_c("low") > 0) & (_c("open") > 0) & (_c("close") > 0), value)


def qlike(actual: Column, forecast: Column) -> Column:
    """Loss of a variance forecast; null unless both are positive."""
    ratio = F.when((actual > 0) & (forecast > 0), actual / forecast)
    return ratio - F.ln(ratio) - 1


def round_to_tick(price: Column, tick: float, digits: int = 4) -> Column:
    """Half up, unlike banker's rounding."""
    return F.round(F.floor(price / tick + 0.5) * tick, digits)


def zone(price: Column, low: Column, high: Column) -> Column:
    middle = (low + high) / 2
    return F.when(price > middle, "premium").when(price < middle, "discount").otherwise("equilibrium")


def neg_log_likelihood(p: Column) -> Column:
    return -F.ln(F.greatest(p, F.lit(1e-15)))


def expected_value(up: Column, down: Column, timeout: Column, reward: float, drift: Column, point_value: float, cost: float) -> Column:
    return point_value * (up * reward - down * reward + timeout * drift) - cost


def has_confluence(price: Column, average: Column, atr: Column, most: float = 1.0) -> Column:
    return F.abs(price - average) <= most * atr


def round_trip_cost(commission: float, spread: float, slip: float, tick: float, point_value: float) -> Column:
    """Cost of a trade in money: the spread and twice the slip, in ticks, and the commission."""
    return F.lit(commission + (spread + 2 * slip) * tick * point_value)


def within_daily_limits(trades: DataFrame, most_loss: float, most_trades: int, losses_in_row: int) -> DataFrame:
    """Trades with ``allowed``: whether the day's earlier ones leave room; columns symbol, day, pos, pnl."""
    line = Window.partitionBy("symbol", "day").orderBy("pos")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    taken = F.count(F.lit(1)).over(earlier)
    wins = F.coalesce(F.sum((F.col("pnl") > 0).cast("int")).over(line.rowsBetween(-losses_in_row, -1)), F.lit(0))
    lost = F.coalesce(F.sum("pnl").over(earlier), F.lit(0.0)) <= -most_loss
    return trades.withColumn("allowed", ~lost & (taken < most_trades) & ~((taken >= losses_in_row) & (wins == 0)))


def class_direction(code: Column, classes: int) -> Column:
    """-1 below the middle class, 1 above it, 0 in it."""
    return F.signum(2 * code - (classes - 1)).cast("int")


def disagreement(first: Column, second: Column) -> Column:
    """How two signs relate; a null sign is none."""
    a, b = F.coalesce(first, F.lit(0.0)), F.coalesce(second, F.lit(0.0))
    return F.when((a == 0) & (b == 0), "neither").when(b == 0, "only_first").when(a == 0, "only_second").when(a == b, "agree").otherwise("oppose")
