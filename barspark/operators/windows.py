"""Causal window operators over bars.

All frames are rows of one symbol in time order, so one exchange and one sort
serve every window of a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barspark.functions.session import eastern
from barspark.operators.ordered import fields, fold

UNBOUNDED = Window.unboundedPreceding


def in_time() -> WindowSpec:
    """A symbol's rows in time order (built on use: a window needs a running session)."""
    return Window.partitionBy("symbol").orderBy("ts")


def rows(first: int, last: int, by: WindowSpec | None = None) -> WindowSpec:
    return (by or in_time()).rowsBetween(first, last)


def day_window() -> WindowSpec:
    return Window.partitionBy("symbol", F.to_date(eastern(F.col("ts")))).orderBy("ts")


def position() -> Column:
    return F.row_number().over(in_time()) - 1


def true_range(previous: Column | None = None) -> Column:
    last = F.lag("close").over(in_time()) if previous is None else previous
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def smoothed(frame: DataFrame, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Recursive averages: name -> (column, weight of the new value, rows before the first result).

    y = y + weight * (x - y), from the first value; nulls leave the average as it
    is.  A symbol's rows are folded in order, in chunks: between them only the
    averages and their counts are carried.
    """

    def step(state: dict, part: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        part = part.copy()
        for name, (column, weight, least) in specs.items():
            value, count = state[name]
            line = pd.concat([pd.Series([value]), part[column].reset_index(drop=True).astype(float)], ignore_index=True)
            mean = line.ewm(alpha=weight, adjust=False, ignore_na=True).mean().to_numpy()[1:]
            counts = count + part[column].notna().cumsum().to_numpy()
            state[name] = (mean[-1] if counts[-1] else float("nan")), int(counts[-1])
            part[name] = np.where(counts >= least, mean, np.nan)
        return state, part

    return fold(frame, ["ts"], lambda: {n: (float("nan"), 0) for n in specs}, step, f"{fields(frame)}, {', '.join(f'{n} double' for n in specs)}")


def ema_spec(column: str, span: int) -> tuple[str, float, int]:
    return column, 2 / (span + 1), span


def wilder_spec(column: str, period: int) -> tuple[str, float, int]:
    return column, 1 / period, period


def with_atr(bars: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    """Average true range with span weights (not Wilder's)."""
    return smoothed(bars.withColumn("tr", true_range()), {name: ema_spec("tr", period)})


def session_vwap() -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    frame = rows(UNBOUNDED, 0, day_window())
    volume = F.sum("volume").over(frame)
    return F.sum(typical * F.col("volume")).over(frame) / F.when(volume != 0, volume)


def centered_swing(column: str, high: bool, k: int) -> Column:
    """Extreme of the rows k before to k after, ties included; null where the frame is cut."""
    frame = rows(-k, k)
    extreme = (F.max if high else F.min)(column).over(frame)
    return F.when(F.count(F.lit(1)).over(frame) == 2 * k + 1, F.col(column) == extreme)


def confirmed(flag: Column, price: str, k: int) -> Column:
    """Price of the last swing, revealed k rows after it."""
    return F.last(F.lag(F.when(flag, F.col(price)), k).over(in_time()), ignorenulls=True).over(rows(UNBOUNDED, 0))


def last_pivots(flag: str, price: str, k: int, n: int) -> Column:
    """The last n swings known at a row, oldest first; those there are not yet are null.

    Each swing carries the ones before it, so a row holds n of them and no more.
    """
    at = F.col(flag)
    chain = [F.when(at, F.struct("pos", price))]
    for _ in range(n - 1):
        chain.append(F.when(at, F.last(chain[-1], ignorenulls=True).over(rows(UNBOUNDED, -1))))
    known = F.last(F.when(at, F.array(*reversed(chain))), ignorenulls=True).over(rows(UNBOUNDED, -k))
    return F.coalesce(known, F.array_repeat(F.lit(None), n))


def fractal(column: str, high: bool, width: int) -> Column:
    """Strictly beyond the rows before, at least level with the rows after."""
    before, after = rows(-width, -1), rows(1, width)
    pick = F.max if high else F.min
    full = (F.count(F.lit(1)).over(before) == width) & (F.count(F.lit(1)).over(after) == width)
    left, right = pick(column).over(before), pick(column).over(after)
    beyond = (F.col(column) > left) & (F.col(column) >= right) if high else (F.col(column) < left) & (F.col(column) <= right)
    return full & beyond


def percent_rank_within(column: str, n: int) -> Column:
    """Average rank of the row among the last n, as a share; null before n rows."""
    values = F.collect_list(column).over(rows(1 - n, 0))
    current = F.col(column)
    less = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.when(x < current, 1.0).otherwise(0.0))
    same = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.when(x == current, 1.0).otherwise(0.0))
    return F.when(F.size(values) == n, (less + (same + 1) / 2) / n)


def change_rate(column: str, n: int) -> Column:
    before = F.lag(column, n).over(in_time())
    return (F.col(column) - before) / before


def island(changed: Column) -> Column:
    return F.sum(changed.cast("int")).over(rows(UNBOUNDED, 0))


def run_length(frame: DataFrame, state: str, name: str = "run") -> DataFrame:
    """Rows since the state last changed, this one included."""
    changed = ~F.col(state).eqNullSafe(F.lag(state).over(in_time())) | (F.row_number().over(in_time()) == 1)
    marked = frame.withColumn("island_", island(changed))
    return marked.withColumn(name, F.row_number().over(Window.partitionBy("symbol", "island_").orderBy("ts"))).drop("island_")


def rows_since(flag: Column) -> Column:
    """Rows since the flag was last set; position plus one before it ever was."""
    return F.col("pos") - F.coalesce(F.last(F.when(flag, F.col("pos")), ignorenulls=True).over(rows(UNBOUNDED, 0)), F.lit(-1))


def trailing_sum(column: Column, n: int, by: WindowSpec) -> Column:
    frame = rows(1 - n, 0, by)
    return F.when(F.count(column).over(frame) == n, F.sum(column).over(frame))


def forward_sum(column: Column, n: int, by: WindowSpec) -> Column:
    frame = rows(1, n, by)
    return F.when(F.count(column).over(frame) == n, F.sum(column).over(frame))


def forward_return(n: int, atr: str = "atr") -> Column:
    return (F.lead("close", n).over(in_time()) - F.col("close")) / F.when(F.col(atr) > 0, F.col(atr))


def log_return(by: WindowSpec) -> Column:
    return F.ln("close") - F.ln(F.lag("close").over(by))


def drawdown(column: str, by: WindowSpec) -> Column:
    return F.col(column) - F.max(column).over(rows(UNBOUNDED, 0, by))


def efficiency_ratio(n: int) -> Column:
    """Net move over n rows by the path walked; needs the column ``step``, each row's absolute change."""
    path = trailing_sum(F.col("step"), n, in_time())
    return F.when(path > 0, F.abs(F.col("close") - F.lag("close", n).over(in_time())) / path)
