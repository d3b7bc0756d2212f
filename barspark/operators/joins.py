"""Joins along time: as-of, range, nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], forward: bool = False, prefix: str = "", strict: bool = False) -> DataFrame:
    """For each left row the last right row at or before it (``forward``: the first at or after it; ``strict``: not at it).

    Both sides are laid into one time line per key and the right side's values
    are carried along it: one exchange and one sort, whatever the match rate.
    Unmatched rows get nulls.
    """
    values = F.struct(*columns)
    kind = right.select(values.alias("v")).schema["v"].dataType
    a = left.select(*by, F.col(left_ts).alias("t_"), F.lit(int(forward == strict)).alias("side_"), F.struct("*").alias("row_"), F.lit(None).cast(kind).alias("v_"))
    row = a.schema["row_"].dataType
    b = right.select(*by, F.col(right_ts).alias("t_"), F.lit(int(forward != strict)).alias("side_"), F.lit(None).cast(row).alias("row_"), values.alias("v_"))
    line = Window.partitionBy(*by).orderBy("t_", "side_")
    if forward:
        carried = F.first("v_", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    else:
        carried = F.last("v_", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    out = a.unionByName(b).withColumn("m_", carried).where("row_ is not null")
    return out.select("row_.*", *(F.col(f"m_.{c}").alias(f"{prefix}{c}") for c in columns))


def in_range(left: DataFrame, right: DataFrame, by: list[str], low: str, high: str, at: str, seconds: int, condition: Column | None = None) -> DataFrame:
    """Right rows whose ``at`` lies in a left row's [low, high].

    Time is cut into cells of ``seconds``; a left row is repeated for each cell
    that it spans, and the join is on key and cell, so no key meets itself as a
    whole.
    """
    cell = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    spread = left.withColumn("cell_", F.explode(F.sequence(cell(low), cell(high))))
    keyed = right.withColumn("cell_", cell(at))
    inside = (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    out = spread.join(keyed, [*by, "cell_"]).where(inside).drop("cell_")
    return out if condition is None else out.where(condition)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a, b or both: columns of ``keys`` and ``side`` (only_a, only_b, both)."""
    both = a.select(*keys, F.lit(1).alias("a_")).distinct().join(b.select(*keys, F.lit(1).alias("b_")).distinct(), keys, "full_outer")
    return both.select(*keys, F.when(F.col("b_").isNull(), "only_a").when(F.col("a_").isNull(), "only_b").otherwise("both").alias("side"))


def nearest_level(rows: DataFrame, levels: DataFrame, by: list[str], value: str, level: str, tolerance: float) -> DataFrame:
    """Rows with the nearest of their key's levels, the lower of two equally near, if within ``tolerance`` times the value.

    Two as-of joins on the price line find the neighbours, so no row meets more than two levels.
    """
    below = as_of(rows, levels.withColumn("p_", F.col(level)), by, value, "p_", [level], prefix="below_")
    both = as_of(below, levels.withColumn("p_", F.col(level)), by, value, "p_", [level], forward=True, prefix="above_")
    low, high, own = F.col(f"below_{level}"), F.col(f"above_{level}"), F.col(value)
    pick = F.when(low.isNull() | (high - own < own - low), high).otherwise(low)
    return both.withColumn(level, pick).where(F.abs(F.col(level) - own) <= tolerance * F.abs(own)).drop(f"below_{level}", f"above_{level}")


def snapshot_difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys of two snapshots: state (added, removed, same, changed) and which values changed."""
    a = old.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("in_a"))
    b = new.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    held = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    differ = {v: held & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values}
    changed = F.concat_ws(",", *(F.when(c, F.lit(v)) for v, c in differ.items()))
    state = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").when(changed == "", "same").otherwise("changed")
    return both.select(*keys, state.alias("state"), changed.alias("fields"))
