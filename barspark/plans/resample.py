"""Resampling with replacement, dealt over tasks.

A key's rows are added up by value and the values dealt by hash into blocks of
about ``per_block``.  How many of a draw's samples fall into a block is settled
along a binary tree over the blocks: at each node a binomial number of the
parent's samples goes left, by the weights of both sides.  Every block walks down
from the root by itself, with generators seeded by draw, key and node, so blocks
agree without talking to each other and a lost task gives the same numbers again.
The result is exact resampling of all rows.  No task holds more than a block, and
a value that a third of all rows share is one weighted value.

Blocks of time are resampled as their sums: a draw takes whole blocks from the sums
of all runs of ``block`` rows, and a last one from the sums of the runs that remain.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the tree at which many blocks ask for one node, which is then laid out several times.
SPREAD_LEVELS = 8


def _keyed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with one text key, which nulls have too."""
    return rows.withColumn("key_", F.to_json(F.struct(*by)))


def resampled_sums(rows: DataFrame, values: list[str], take: str, draws: int, seed: int, per_block: int = 4096) -> DataFrame:
    """key_, draw and the sum of each of ``values`` over ``take`` rows of the key, drawn with replacement.

    ``rows`` has key_, the values (doubles, not null) and take (the same for all rows of
    a key; with 0 all sums are 0).
    """
    weighed = rows.groupBy("key_", *values).agg(F.count("*").alias("w_"), F.first(take).cast("long").alias("take_"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("distinct_") / per_block)).cast("int"))
    depths = weighed.groupBy("key_").agg(F.count("*").alias("distinct_")).select("key_", depth.alias("depth_"))
    dealt = weighed.join(depths, "key_").withColumn("block_", F.xxhash64(F.lit(seed), *values).bitwiseAND(F.expr("shiftleft(1L, depth_) - 1")))
    cells = dealt.groupBy("key_", "block_").agg(F.sum("w_").alias("w_"), F.first("take_").alias("take_"), F.first("depth_").alias("depth_"))

    steps = cells.withColumn("level_", F.explode(F.expr("CASE WHEN depth_ > 0 THEN sequence(1, depth_) END"))).withColumn("node_", F.expr("shiftright(block_, depth_ - level_)"))
    steps = steps.withColumn("parent_", F.expr("shiftright(node_, 1)")).withColumn("left_", F.col("node_") % 2 == 0)
    copies = f"shiftleft(1, greatest(0, {SPREAD_LEVELS} - level_))"
    nodes = steps.groupBy("key_", "level_", "parent_").agg((F.sum(F.when(F.col("left_"), F.col("w_")).otherwise(0)) / F.sum("w_")).alias("share_"))
    nodes = nodes.withColumn("copy_", F.explode(F.expr(f"sequence(0, {copies} - 1)")))
    walks = steps.withColumn("copy_", F.expr(f"cast(pmod(xxhash64(block_), {copies}) AS int)")).join(nodes, ["key_", "level_", "parent_", "copy_"])
    walks = walks.groupBy("key_", "block_").agg(F.array_sort(F.collect_list(F.struct("level_", "parent_", "share_", "left_"))).alias("walk_"))
    paths = cells.select("key_", "block_", "take_").join(walks, ["key_", "block_"], "left").select(F.col("key_").alias("of_"), F.col("block_").alias("at_"), "take_", "walk_")

    def draw(group: tuple, held: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        key, block = zlib.crc32(group[0].encode()), int(group[1])
        counts = np.full(draws, int(path["take_"].iat[0]), np.int64)
        walk = path["walk_"].iat[0]
        for step in () if walk is None else walk:
            left = np.random.default_rng([seed, key, step["level_"], step["parent_"]]).binomial(counts, step["share_"])
            counts = left if step["left_"] else counts - left
        held = held.sort_values(values, kind="stable")
        weight, table = held["w_"].to_numpy(float), held[values].to_numpy(float)
        rng = np.random.default_rng([seed, key, 0, block])
        chunk = max(1, (1 << 20) // len(held))
        sums = np.concatenate([rng.multinomial(counts[at : at + chunk], weight / weight.sum()) @ table for at in range(0, draws, chunk)])
        return pd.DataFrame({"key_": group[0], "draw": np.arange(draws, dtype=np.int32)} | {name: sums[:, i] for i, name in enumerate(values)})

    schema = "key_ string, draw int, " + ", ".join(f"`{v}` double" for v in values)
    parts = dealt.select("key_", "block_", "w_", *values).groupBy("key_", "block_").cogroup(paths.groupBy("of_", "at_")).applyInPandas(draw, schema)
    return parts.groupBy("key_", "draw").agg(*(F.sum(v).alias(v) for v in values))


def run_sums(rows: DataFrame, values: list[str], order: str, block: int, circular: bool) -> tuple[DataFrame, DataFrame]:
    """Sums of the runs of ``block`` rows from each start, and of the shorter runs that fill a draw up to a key's n rows.

    Both have key_, the values and take_.  Without ``circular`` a run starts where a
    whole one fits (at the first row if none does).  ``rows`` has one row a key and
    period; its order within a key is one window.
    """
    line = Window.partitionBy("key_").orderBy(order, *values)
    placed = rows.withColumn("pos_", F.row_number().over(line) - 1).withColumn("n_", F.count("*").over(Window.partitionBy("key_")))
    placed = placed.withColumn("whole_", F.ceil(F.col("n_") / block) - 1).select("key_", "pos_", "n_", "whole_", *values)
    # Rows before `block` come once more behind the end, as often as a run around the end needs them.
    lap = F.expr(f"sequence(0, cast(CASE WHEN pos_ < {block} THEN ceil({block} / n_) ELSE 0 END AS int))") if circular else F.array(F.lit(0))
    laid = placed.withColumn("lap_", F.explode(lap)).withColumn("at_", F.col("pos_") + F.col("lap_") * F.col("n_"))
    ahead = lambda length: Window.partitionBy("key_").orderBy("at_").rowsBetween(0, length - 1)
    rest = F.col("n_") - F.col("whole_") * block
    # The run that remains is of one of `block` lengths, the same for a whole key.
    cut = lambda v: F.coalesce(*(F.when(rest == length, F.sum(v).over(ahead(length))) for length in range(1, block + 1)))
    starts = F.col("lap_") == 0
    if not circular:
        starts = starts & (F.col("at_") <= F.greatest(F.lit(0), F.col("n_") - block))
    summed = laid.select("key_", "n_", "whole_", "lap_", "at_", *(F.struct(F.sum(v).over(ahead(block)).alias("a"), cut(v).alias("b")).alias(v) for v in values)).where(starts)
    return (
        summed.select("key_", F.col("whole_").alias("take_"), *(F.col(f"{v}.a").alias(v) for v in values)),
        summed.select("key_", F.lit(1).cast("long").alias("take_"), *(F.col(f"{v}.b").alias(v) for v in values)),
    )


def drawn(rows: DataFrame, values: list[str], draws: int, seed: int, block: int = 1, order: str | None = None, circular: bool = True, per_block: int = 4096) -> DataFrame:
    """key_, draw and the sum of each value over n rows of the key: single rows, or runs of ``block`` in ``order``."""
    if block == 1:
        n = rows.groupBy("key_").agg(F.count("*").alias("take_"))
        return resampled_sums(rows.join(n, "key_"), values, "take_", draws, seed, per_block)
    whole, last = run_sums(rows, values, order, block, circular)
    both = resampled_sums(whole, values, "take_", draws, seed, per_block).unionByName(resampled_sums(last, values, "take_", draws, seed + 1, per_block))
    return both.groupBy("key_", "draw").agg(*(F.sum(v).alias(v) for v in values))


def _interval(draws: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """key_, mean_, low, high and p, the share of draws at most zero."""
    cut = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return draws.groupBy("key_").agg(F.avg(value).alias("mean_"), cut[0].alias("low"), cut[1].alias("high"), F.avg((F.col(value) <= 0).cast("double")).alias("p"))


def bootstrap_mean(rows: DataFrame, value: str, by: str, draws: int = 2000, block: int = 1, order: str | None = None, seed: int = 42, circular: bool = True, per_block: int = 4096) -> DataFrame:
    """key, n, mean, its interval from 5 to 95 % by resampling of rows or blocks of time, and the share of means at most zero.

    Null values take no part.  One value has itself as interval; none is no row.
    """
    kept = _keyed(rows.where(F.col(value).isNotNull()), [by]).select("key_", F.col(by).cast("string").alias("key"), F.col(value).cast("double").alias("v_"), *([F.col(order).alias("order_")] if order else []))
    seen = kept.groupBy("key_").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.avg("v_").alias("mean"))
    sums = drawn(kept, ["v_"], draws, seed, block, "order_", circular, per_block)
    means = sums.join(seen.select("key_", "n"), "key_").withColumn("m_", F.col("v_") / F.col("n"))
    return seen.join(_interval(means, "m_", 0.05, 0.95), "key_").select("key", "n", "mean", "low", "high", "p")


def bootstrap_spread(rows: DataFrame, value: str, cell: str, by: str, draws: int = 2000, seed: int = 42, per_block: int = 4096) -> DataFrame:
    """Resampled difference of a value's mean between a key's highest and lowest cell: key, mean, low, high, p (share at most zero).

    Both cells are resampled apart.  Keys of one cell have no row.
    """
    edges = _keyed(rows, [by]).groupBy("key_").agg(F.first(F.col(by).cast("string")).alias("key"), F.min(cell).alias("low_"), F.max(cell).alias("high_"))
    ends = _keyed(rows.where(F.col(value).isNotNull()), [by]).join(edges.where("low_ < high_"), "key_").where((F.col(cell) == F.col("low_")) | (F.col(cell) == F.col("high_")))
    ends = ends.select(F.col("key_").alias("of_"), (F.col(cell) == F.col("high_")).alias("top_"), F.col(value).cast("double").alias("v_"))
    ends = ends.withColumn("key_", F.concat("of_", F.col("top_").cast("string")))
    cells = ends.groupBy("key_").agg(F.first("of_").alias("of_"), F.first("top_").alias("top_"), F.count("*").alias("n_"))
    means = drawn(ends, ["v_"], draws, seed, per_block=per_block).join(cells, "key_").withColumn("m_", F.col("v_") / F.col("n_"))
    side = lambda top: F.sum(F.when(F.col("top_") == top, F.col("m_")))
    gaps = means.groupBy(F.col("of_").alias("key_"), "draw").agg((side(True) - side(False)).alias("gap_"))
    return _interval(gaps, "gap_", 0.05, 0.95).join(edges, "key_").select("key", F.col("mean_").alias("mean"), "low", "high", "p")


def _sharpe(total: Column, squares: Column, centre: Column, n: Column) -> Column:
    """Yearly Sharpe ratio from the sum and the sum of squares about ``centre``; 0 where all rows are equal but for rounding."""
    rest = squares - total * total / n
    return F.when(rest > 1e-12 * squares, (centre + total / n) / F.sqrt(rest / (n - 1)) * math.sqrt(252)).otherwise(0.0)


def bootstrap_sharpe_difference(daily: DataFrame, a: str, b: str, by: str, order: str, block: int = 5, draws: int = 2000, seed: int = 20260724, per_block: int = 4096) -> DataFrame:
    """Difference of two daily series' Sharpe ratios, with days drawn in circular blocks for both at once: key, observed, low, high, p.

    Keys of one day have 0 as difference and interval, and p 1.
    """
    kept = _keyed(daily.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [by])
    kept = kept.select("key_", F.col(by).cast("string").alias("key"), F.col(order).alias("order_"), F.col(a).cast("double").alias("a_"), F.col(b).cast("double").alias("b_"))
    seen = kept.groupBy("key_").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.avg("a_").alias("ma"), F.avg("b_").alias("mb"))
    centred = kept.join(seen.select("key_", "ma", "mb"), "key_").withColumn("a_", F.col("a_") - F.col("ma")).withColumn("b_", F.col("b_") - F.col("mb"))
    centred = centred.withColumn("aa_", F.col("a_") * F.col("a_")).withColumn("bb_", F.col("b_") * F.col("b_")).drop("ma", "mb")
    values, n = ["a_", "aa_", "b_", "bb_"], F.col("n")
    gap = F.when(n > 1, _sharpe(F.col("a_"), F.col("aa_"), F.col("ma"), n) - _sharpe(F.col("b_"), F.col("bb_"), F.col("mb"), n)).otherwise(0.0)
    gaps = drawn(centred, values, draws, seed, block, "order_", True, per_block).join(seen, "key_").withColumn("gap_", gap)
    real = centred.groupBy("key_").agg(*(F.sum(v).alias(v) for v in values)).join(seen, "key_").select("key_", "key", gap.alias("observed"))
    return real.join(_interval(gaps, "gap_", 0.025, 0.975), "key_").select("key", "observed", "low", "high", "p")
