"""Path-dependent simulation: one ordered fold per symbol or run.

A position decides whether the next signal counts, so a run's bars are folded in
order, in chunks that hand on a small state.  Runs are independent: they are dealt
out by symbol (and by whatever else tells runs apart).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.session import eastern, minute_of_day
from barspark.operators.firsthit import FAR, resolved
from barspark.operators.ordered import fold


@dataclass(frozen=True)
class BacktestConfig:
    equity: float = 50_000.0
    risk: float = 0.005
    most: int = 20
    point_value: float = 2.0
    commission: float = 1.0
    slip: float = 0.05
    stop_atr: float = 1.5
    target_r: float = 1.5
    windows: tuple[tuple[int, int], ...] = ((570, 960),)
    daily_loss: float = 0.03
    trades_a_day: int = 5
    losses_in_row: int = 3


TRADES = "symbol string, entry_ts long, exit_ts long, direction int, contracts int, entry double, exit double, pnl double, r double, reason string, equity double"


def backtest(bars: DataFrame, config: BacktestConfig) -> DataFrame:
    """Trades of bars with ``direction`` and ``atr``: stop before target, flat at the day's last bar, daily limits.

    Order within a bar: day reset, exit, then entry while flat, inside a window
    and within the limits.  Size comes from the equity at that moment; a size of
    zero is no trade.
    """
    local = eastern(F.col("ts"))
    frame = bars.select(
        "symbol", "ts", "open", "high", "low", "close", "atr", F.col("direction").cast("double").alias("direction"),
        F.unix_date(F.to_date(local)).alias("day"), minute_of_day(local).alias("minute"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
    )
    frame = frame.withColumn("last", ~F.col("day").eqNullSafe(F.lead("day").over(Window.partitionBy("symbol").orderBy("t"))))

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        high, low, close, atr, side, day, minute, t = (part[c].to_numpy(float) for c in ("high", "low", "close", "atr", "direction", "day", "minute", "t"))
        last = part["last"].to_numpy(bool)
        allowed = np.zeros(len(t), bool)
        for start, end in config.windows:
            allowed |= (minute >= start) & (minute < end)
        equity, trade, today, pnl_today, losses, count = state
        out: list[tuple] = []
        for i in range(len(t)):
            if day[i] != today:
                today, pnl_today, losses, count = day[i], 0.0, 0, 0
            if trade is not None:
                d, entry, stop, target, size, at = trade
                hit_stop = low[i] <= stop if d > 0 else high[i] >= stop
                hit_target = high[i] >= target if d > 0 else low[i] <= target
                reason, price = ("session", close[i]) if last[i] else ("stop", stop) if hit_stop else ("target", target) if hit_target else (None, 0.0)
                if reason:
                    fill = price - d * config.slip
                    pnl = (fill - entry) * d * config.point_value * size - config.commission * size
                    equity += pnl
                    pnl_today += pnl
                    count += 1
                    losses = 0 if pnl > 0 else losses + 1
                    risk = abs(entry - stop) * config.point_value * size
                    out.append((part["symbol"].iat[0], int(at), int(t[i]), int(d), size, entry, fill, pnl, pnl / risk if risk else 0.0, reason, equity))
                    trade = None
            within = pnl_today > -config.daily_loss * equity and count < config.trades_a_day and losses < config.losses_in_row
            if trade is None and not last[i] and allowed[i] and within and side[i] == side[i] and side[i] and atr[i] > 0:
                d = side[i]
                entry = close[i] + d * config.slip
                stop = close[i] - d * config.stop_atr * atr[i]
                size = int(min(config.most, equity * config.risk // (abs(entry - stop) * config.point_value)))
                if size > 0:
                    trade = (d, entry, stop, close[i] + d * config.stop_atr * config.target_r * atr[i], size, t[i])
        return (equity, trade, today, pnl_today, losses, count), pd.DataFrame(out, columns=[f.split()[0] for f in TRADES.split(", ")])

    return fold(frame, ["t"], lambda: (config.equity, None, None, 0.0, 0, 0), step, TRADES)


def rising_edge(signals: DataFrame, cooldown: int) -> DataFrame:
    """Rows where the direction becomes another nonzero one, at least ``cooldown`` rows after the last taken."""

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        before, last, at = state  # direction of the row before, row last taken, rows so far
        side = part["direction"].to_numpy(float)
        edges = np.flatnonzero((side != 0) & (side == side) & (side != np.append(before, side[:-1])))
        taken = []
        for i in edges:
            if last is None or at + i - last > cooldown:
                taken.append(i)
                last = at + i
        return (side[-1], last, at + len(side)), part.iloc[taken]

    return fold(signals.select("symbol", "ts", "direction"), ["ts"], lambda: (0.0, None, 0), step, "symbol string, ts timestamp_ntz, direction double")


RISK = "symbol string, day string, pos long, pnl double, taken boolean, balance double"


def risk_policy(candidates: DataFrame, point_value: float, size: int = 5, start: float = 50_000.0, max_loss: float = 2_000.0, buffered_loss: float = 1_600.0, daily_stop: float = 800.0, most: int = 3, cooldown: int = 3) -> DataFrame:
    """Candidates after one-position, cooldown, per-day and trailing-loss rules; those blocked by risk have taken = false."""

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        balance, peak, today, pnl_day, halted, count, busy = state
        out: list[tuple] = []
        for row in part.itertuples(index=False):
            if row.day != today:
                peak = max(peak, balance)
                today, pnl_day, halted, count, busy = row.day, 0.0, False, 0, -1
            if row.pos <= busy or count >= most:
                continue
            worst = abs(row.entry - row.stop) * point_value * size
            floor = min(peak - max_loss, start) + max_loss - buffered_loss
            if halted or pnl_day - worst <= -daily_stop or balance - worst <= floor:
                out.append((row.symbol, row.day, row.pos, 0.0, False, balance))
                continue
            pnl = (row.exit - row.entry) * (1 if row.is_long else -1) * point_value * size
            balance += pnl
            pnl_day += pnl
            halted = pnl_day <= -daily_stop
            count += 1
            busy = row.exit_pos + cooldown
            out.append((row.symbol, row.day, row.pos, pnl, True, balance))
        return (balance, peak, today, pnl_day, halted, count, busy), pd.DataFrame(out, columns=[f.split()[0] for f in RISK.split(", ")])

    return fold(candidates, ["pos"], lambda: (start, start, None, 0.0, False, 0, -1), step, RISK)


CHANNEL = "symbol string, entry_ts long, direction int, entry double, exit double, bars long, reason string"


def channel(bars: DataFrame, k: float, m: float, slip: float, distance: str = "atr") -> DataFrame:
    """Trailing stop k and fixed target m distances from next-open entries of ``direction`` rows; one position at a time.

    The stop ratchets with the running extreme at each close and acts from the
    next bar; gaps fill at the open; stop comes before target; the day's last
    bar closes what is open.
    """
    frame = bars.select("symbol", "open", "high", "low", "close", F.col(distance).alias("dist"), F.col("direction").cast("double").alias("direction"), F.unix_date(F.to_date(eastern(F.col("ts")))).alias("day"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    frame = frame.withColumn("last", ~F.col("day").eqNullSafe(F.lead("day").over(Window.partitionBy("symbol").orderBy("t"))))

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        trade, signal = state  # what is open; direction and day of the row before, if it may enter here
        o, h, l, c, dist, side, day, t = (part[x].to_numpy(float) for x in ("open", "high", "low", "close", "dist", "direction", "day", "t"))  # noqa: E741
        last = part["last"].to_numpy(bool)
        out: list[tuple] = []
        for j in range(len(t)):
            price, reason = None, None
            if trade is None and signal is not None and signal[1] == day[j] and dist[j] == dist[j]:
                d = signal[0]
                entry = o[j] + d * slip
                trade = [d, t[j], entry, entry + d * m * dist[j], entry - d * k * dist[j], entry, 0]
                if last[j]:
                    price, reason = c[j] - d * slip, "session"
            elif trade is not None:
                d, _, _, target, stop, _, _ = trade
                trade[6] += 1
                gap_stop, gap_target = d * (o[j] - stop) <= 0, d * (o[j] - target) >= 0
                worst, best = (l[j], h[j]) if d > 0 else (h[j], l[j])
                if gap_stop or d * (worst - stop) <= 0:
                    price, reason = (o[j] if gap_stop else stop - d * slip), "stop"
                elif last[j]:
                    price, reason = c[j] - d * slip, "session"
                elif gap_target or d * (best - target) >= 0:
                    price, reason = (target if gap_target else target - d * slip), "target"
            if reason:
                out.append((part["symbol"].iat[0], int(trade[1]), int(trade[0]), trade[2], price, trade[6], reason))
                trade = None
            elif trade is not None:
                d = trade[0]
                trade[5] = max(trade[5], h[j]) if d > 0 else min(trade[5], l[j])
                if dist[j] == dist[j]:
                    trade[4] = max(trade[4], trade[5] - k * dist[j]) if d > 0 else min(trade[4], trade[5] + k * dist[j])
            # a row's signal counts if nothing is open once the row is over
            signal = (side[j], day[j]) if trade is None and side[j] == side[j] and side[j] else None
        return (trade, signal), pd.DataFrame(out, columns=[f.split()[0] for f in CHANNEL.split(", ")])

    return fold(frame, ["t"], lambda: (None, None), step, CHANNEL)


def track(entries: DataFrame, bars: DataFrame, target: float, horizon: int) -> DataFrame:
    """Tickets (id, symbol, pos, is_long, price, stop) resolved against later bars.

    status: closed by target or stop (ambiguous bars are stops), horizon, or
    open while bars are still missing; r: multiples of risk.  Tickets do not
    depend on one another, so this is one pass over bars and levels.
    """
    found = resolved(entries, bars, [target], horizon)
    t, s = F.coalesce("hit_0", F.lit(FAR)), F.coalesce("stop_at", F.lit(FAR))
    status = F.when((t == FAR) & (s == FAR), F.when(F.col("have") < horizon, "open").otherwise("horizon")).when(t == s, "ambiguous").when(t < s, "target").otherwise("stop")
    r = F.when(F.col("status") == "target", F.lit(target)).when(F.col("status").isin("stop", "ambiguous"), F.lit(-1.0)).otherwise(F.col("mark"))
    return found.withColumn("status", status).withColumn("r", F.round(r, 6)).withColumn("bars", F.least(t, s, F.col("have"))).select("id", "status", "r", "bars")


def breakeven(curve: DataFrame, by: list[str]) -> DataFrame:
    """Slippage at which the mean result crosses zero, interpolated on ``curve(slip, result)``."""
    w = Window.partitionBy(*by).orderBy("slip")
    ahead = curve.withColumn("s1", F.lead("slip").over(w)).withColumn("r1", F.lead("result").over(w)).where("result > 0 and r1 <= 0")
    cross = F.col("slip") + (F.col("s1") - F.col("slip")) * F.col("result") / (F.col("result") - F.col("r1"))
    return ahead.groupBy(*by).agg(F.min(cross).alias("breakeven"))


def peak_confirm(signals: DataFrame, cooldown: int) -> DataFrame:
    """Rows at which a direction's strength first falls from its running maximum; quiet for ``cooldown`` rows afterwards.

    ``signals(symbol, ts, direction, strength)``; a null or zero direction, or
    the other one, ends a streak without a signal.
    """

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        armed, peak, quiet, at = state
        side, strength = part["direction"].to_numpy(float), part["strength"].to_numpy(float)
        taken = []
        for i in range(len(side)):
            d = side[i]
            if d != d or not d or at + i <= quiet:
                armed, peak = 0.0, -np.inf
            elif d != armed:
                armed, peak = d, strength[i]
            elif strength[i] >= peak:
                peak = strength[i]
            else:
                taken.append(i)
                quiet, armed, peak = at + i + cooldown, 0.0, -np.inf
        return (armed, peak, quiet, at + len(side)), part.iloc[taken][["symbol", "ts", "direction"]]

    return fold(signals.select("symbol", "ts", "direction", "strength"), ["ts"], lambda: (0.0, -np.inf, -1, 0), step, "symbol string, ts timestamp_ntz, direction double")


def entry_calendar(bars: DataFrame) -> DataFrame:
    """Signal rows that a book of one position would act on, whatever its stops.

    ``bars(symbol, ts, direction, day, flat)``: an entry takes place at the next
    bar of the same day; an opposite signal closes it at the bar after; a flat
    bar closes it at once.
    """

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        held, fresh, enter, leave, since = state  # position, taken at this bar, what waits and the day it was decided
        side, flat, day = part["direction"].to_numpy(float), part["flat"].to_numpy(bool), part["day"].to_numpy()
        taken = []
        for i in range(len(side)):
            if (enter or leave) and day[i] != since:
                enter, leave = 0.0, False
            fresh = False
            if leave and held:
                held, leave = 0.0, False
            if enter and not held:
                held, enter, fresh = enter, 0.0, True
            if held and not fresh:
                if flat[i]:
                    held = 0.0
                elif side[i] == -held:
                    leave, since = True, day[i]
            if not held and not enter and not leave and side[i] == side[i] and side[i]:
                enter, since = side[i], day[i]
                taken.append(i)
        return (held, fresh, enter, leave, since), part.iloc[taken][["symbol", "ts", "direction"]]

    rows = bars.select("symbol", "ts", F.col("direction").cast("double").alias("direction"), F.unix_date("day").alias("day"), "flat")
    return fold(rows, ["ts"], lambda: (0.0, False, 0.0, False, None), step, "symbol string, ts timestamp_ntz, direction double")


BOOK = "symbol string, entry_ts long, exit_ts long, direction int, entry double, stop double, exit double, r double, bars long, reason string"


def shadow_book(bars: DataFrame, stop_atr: float, slip: float, commission: float, most: int) -> DataFrame:
    """Trades of a book of one position that goes on overnight: entry at a signal's close, exit by stop, reversal or age.

    The stop fills at the worse of its price and the open; an expected value
    that turns against the position closes it at the next open; ``most`` bars at
    the most.
    """

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        trade = state[0]
        o, h, l, c, atr, ev, side, t = (part[x].to_numpy(float) for x in ("open", "high", "low", "close", "atr", "ev", "direction", "t"))  # noqa: E741
        out: list[tuple] = []
        for i in range(len(t)):
            if trade is not None:
                d, at, entry, stop, leave, age = trade
                age += 1
                raw, reason = None, ""
                if (l[i] <= stop) if d > 0 else (h[i] >= stop):
                    raw, reason = (min(stop, o[i]) if d > 0 else max(stop, o[i])), "stop"
                elif leave:
                    raw, reason = o[i], "reversal"
                elif age >= most:
                    raw, reason = c[i], "age"
                elif ev[i] == ev[i] and d * ev[i] <= 0:
                    leave = True
                trade = (d, at, entry, stop, leave, age)
                if raw is not None:
                    fill = raw - d * slip
                    out.append((part["symbol"].iat[0], int(at), int(t[i]), int(d), entry, stop, fill, ((fill - entry) * d - commission) / abs(entry - stop), age, reason))
                    trade = None
            if trade is None and side[i] == side[i] and side[i] and atr[i] > 0:
                d = side[i]
                trade = (d, t[i], c[i] + d * slip, c[i] - d * stop_atr * atr[i], False, 0)
        return (trade,), pd.DataFrame(out, columns=[f.split()[0] for f in BOOK.split(", ")])

    rows = bars.select("symbol", "open", "high", "low", "close", "atr", "ev", F.col("direction").cast("double").alias("direction"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return fold(rows, ["t"], lambda: (None,), step, BOOK)


def slippage_curve(trades: DataFrame, ticks: list[float], tick: float, commission: float) -> DataFrame:
    """Mean result of trades, in multiples of risk, when each side slips by so many ticks."""
    rows = trades.withColumn("ticks", F.explode(F.array(*map(F.lit, ticks))))
    slip = F.col("ticks") * tick
    entry, out = F.col("entry") + F.col("direction") * slip, F.col("exit") - F.col("direction") * slip
    r = ((out - entry) * F.col("direction") - commission) / F.abs(entry - F.col("stop"))
    return rows.groupBy("symbol", "ticks").agg(F.count("*").alias("n"), F.avg(r).alias("mean_r"))
