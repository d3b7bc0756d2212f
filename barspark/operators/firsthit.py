"""First-hit operators: which bar after an entry first satisfies a condition."""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.ordered import fields, fold
from barspark.operators.windows import rows

FAR = 1 << 30


def steps_ahead(condition, n: int, columns: list[str], by=None) -> Column:  # noqa: ANN001
    """Steps to the first of the next n rows that satisfies ``condition(row)``; null if none does."""
    ahead = F.collect_list(F.struct(*columns)).over(rows(1, n, by))
    hits = F.transform(ahead, lambda x, i: F.when(condition(x), i + 1))
    return F.array_min(hits)


def triple_barrier(bars: DataFrame, up: Column, down: Column, n: int, by=None) -> DataFrame:  # noqa: ANN001
    """outcome (up, down, ambiguous, timeout), steps and price move to the exit of an entry at each close.

    Within the next n rows: ``ambiguous`` where both barriers fall into one bar.
    Rows without n following rows time out at the last they have; rows without
    any have a null outcome.
    """
    marked = bars.withColumn("up_", up).withColumn("down_", down)
    marked = marked.withColumn("u_", steps_ahead(lambda x: x["high"] >= F.col("up_"), n, ["high"], by)).withColumn("d_", steps_ahead(lambda x: x["low"] <= F.col("down_"), n, ["low"], by))
    u, d = F.coalesce("u_", F.lit(FAR)), F.coalesce("d_", F.lit(FAR))
    have = F.count(F.lit(1)).over(rows(1, n, by))
    outcome = F.when((have == 0) | F.col("up_").isNull(), None).when((u == FAR) & (d == FAR), "timeout").when(u == d, "ambiguous").when(u < d, "up").otherwise("down")
    marked = marked.withColumn("outcome", outcome).withColumn("steps", F.when(F.col("outcome").isNotNull(), F.least(u, d, have.cast("int"))))
    closes = F.collect_list("close").over(rows(1, n, by))
    move = F.when(F.col("outcome") == "up", F.col("up_")).when(F.col("outcome") == "down", F.col("down_")).when(F.col("outcome").isNotNull(), F.try_element_at(closes, F.col("steps"))) - F.col("close")
    return marked.withColumn("move", move).drop("up_", "down_", "u_", "d_")


def first_beyond(points: DataFrame, bars: DataFrame, since: str, up: str = "high", down: str = "low", strict: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """The first bar after position ``since`` that passes each point's ``level``, however far ahead.

    ``points(symbol, side, level, ...)``: side 1 asks for ``up`` above the level,
    -1 for ``down`` below it; ``strict`` excludes the level itself.  Adds hit_pos
    and, as ``hit_<name>``, the columns of that bar in ``carry``; null where no bar
    passes.  Points of a null side or level are never passed.

    Bars and points go along one time line.  Open levels wait in two heaps, so a
    bar touches only those that it passes, and memory holds open levels alone.
    """
    own = [c for c in points.columns if c != "symbol"]
    marks = list(dict.fromkeys([up, down, *carry]))
    line = points.select("symbol", F.col(since).alias("line_"), F.lit(1).alias("point_"), *own, *(F.lit(None).cast("double").alias(f"bar_{c}") for c in marks))
    # a bar of a position comes before the points that wait from there on
    line = line.unionByName(bars.select("symbol", F.col("pos").alias("line_"), F.lit(0).alias("point_"), *(F.col(c).cast("double").alias(f"bar_{c}") for c in marks)), allowMissingColumns=True)
    names = ["symbol", *own, "hit_pos", *(f"hit_{c}" for c in carry)]
    schema = f"{fields(points.select('symbol', *own))}, hit_pos long" + "".join(f", hit_{c} double" for c in carry)

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        above, below, count, _ = state
        at, is_point = part["line_"].to_numpy(), part["point_"].to_numpy()
        sides, levels = part["side"].to_numpy(float), part["level"].to_numpy(float)
        high, low = part[f"bar_{up}"].to_numpy(), part[f"bar_{down}"].to_numpy()
        taken = [part[f"bar_{c}"].to_numpy() for c in carry]
        rows = part[["symbol", *own]].to_numpy(object)
        out: list[tuple] = []
        for i in range(len(part)):
            if is_point[i]:
                side, level = sides[i], levels[i]
                if side == side and level == level and side:
                    heapq.heappush(above if side > 0 else below, (level if side > 0 else -level, count, tuple(rows[i])))
                    count += 1
                else:
                    out.append((*rows[i], None, *(None for _ in carry)))
                continue
            for heap, value in ((above, high[i]), (below, -low[i])):
                while heap and (heap[0][0] < value or (not strict and heap[0][0] == value)):
                    out.append((*heapq.heappop(heap)[2], at[i], *(c[i] for c in taken)))
        return (above, below, count, None), pd.DataFrame(out, columns=names)

    def finish(state: tuple) -> pd.DataFrame:
        rest = [(*row, None, *(None for _ in carry)) for heap in state[:2] for _, _, row in heap]
        return pd.DataFrame(rest, columns=names)

    return fold(line, ["line_", "point_"], lambda: ([], [], 0, None), step, schema, finish)


def resolved(entries: DataFrame, bars: DataFrame, multiples: list[float], horizon: int) -> DataFrame:
    """For entries (id, symbol, pos, is_long, price, stop): bars to the stop and to each multiple of risk, and the last close.

    Columns stop_at and hit_0, hit_1, ...: bars from the entry, null if none
    within ``horizon``; mark: the last close of the horizon in multiples of
    risk; have: bars that there are of it.  Entries without risk are left out.
    """
    risk = F.abs(F.col("price") - F.col("stop"))
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    levels = [F.struct(F.lit(-1).alias("what"), (-side).alias("side"), F.col("stop").alias("level"))]
    levels += [F.struct(F.lit(i).alias("what"), side.alias("side"), (F.col("price") + side * m * risk).alias("level")) for i, m in enumerate(multiples)]
    open_ = entries.where(risk > 0)
    points = open_.select("symbol", "id", "pos", F.explode(F.array(*levels)).alias("x")).select("symbol", "id", "pos", "x.*")
    hits = first_beyond(points, bars, "pos", strict=False).withColumn("k", F.col("hit_pos") - F.col("pos")).where(F.col("k") <= horizon)
    columns = {"stop_at": -1, **{f"hit_{i}": i for i in range(len(multiples))}}
    first = hits.groupBy("id").agg(*(F.min(F.when(F.col("what") == i, F.col("k"))).alias(n) for n, i in columns.items()))
    line = Window.partitionBy("symbol").orderBy("pos")
    ahead = bars.select("symbol", "pos", F.last("close").over(line.rowsBetween(1, horizon)).alias("last_close"), F.count(F.lit(1)).over(line.rowsBetween(1, horizon)).alias("have"))
    out = open_.join(ahead, ["symbol", "pos"]).join(first, "id", "left")
    return out.withColumn("mark", side * (F.col("last_close") - F.col("price")) / risk)


def fixed_target(entries: DataFrame, bars: DataFrame, multiples: list[float], horizon: int) -> DataFrame:
    """Realized multiples of risk for entries (id, symbol, pos, is_long, price, stop) under fixed targets.

    A bar that reaches stop and target is ambiguous and counts as the stop; an
    entry that reaches neither is marked at the last bar of the horizon.  Entries
    without a later bar are left out.
    """
    out = resolved(entries, bars, multiples, horizon).where("have > 0")
    stop_at = F.coalesce("stop_at", F.lit(FAR))
    for i, m in enumerate(multiples):
        hit = F.coalesce(f"hit_{i}", F.lit(FAR))
        out = out.withColumn(f"r_{i}", F.when((hit == FAR) & (stop_at == FAR), F.col("mark")).when(hit < stop_at, F.lit(float(m))).otherwise(F.lit(-1.0)))
    return out


def first_inside(points: DataFrame, bars: DataFrame, since: str) -> DataFrame:
    """The first bar at or after position ``since`` whose range holds each point's ``level``, however far ahead.

    ``points(symbol, level, ...)``; adds hit_pos, null where no bar does.  Open
    levels wait in a sorted list, of which a bar takes the slice in its range.
    """
    own = [c for c in points.columns if c != "symbol"]
    line = points.select("symbol", F.col(since).alias("line_"), F.lit(0).alias("point_"), *own, F.lit(None).cast("double").alias("bar_high"), F.lit(None).cast("double").alias("bar_low"))
    line = line.unionByName(bars.select("symbol", F.col("pos").alias("line_"), F.lit(1).alias("point_"), F.col("high").alias("bar_high"), F.col("low").alias("bar_low")), allowMissingColumns=True)
    names = ["symbol", *own, "hit_pos"]
    schema = f"{fields(points.select('symbol', *own))}, hit_pos long"

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        levels, waiting = state  # sorted alike
        at, is_bar, level = part["line_"].to_numpy(), part["point_"].to_numpy(), part["level"].to_numpy(float)
        high, low = part["bar_high"].to_numpy(), part["bar_low"].to_numpy()
        rows = part[["symbol", *own]].to_numpy(object)
        out: list[tuple] = []
        for i in range(len(part)):
            if is_bar[i]:
                a, b = bisect.bisect_left(levels, low[i]), bisect.bisect_right(levels, high[i])
                out += [(*row, at[i]) for row in waiting[a:b]]
                del levels[a:b], waiting[a:b]
            elif level[i] == level[i]:
                place = bisect.bisect_right(levels, level[i])
                levels.insert(place, level[i])
                waiting.insert(place, tuple(rows[i]))
            else:
                out.append((*rows[i], None))
        return (levels, waiting), pd.DataFrame(out, columns=names)

    return fold(line, ["line_", "point_"], lambda: ([], []), step, schema, lambda state: pd.DataFrame([(*row, None) for row in state[1]], columns=names))
