"""Where and how long price stalls after a setup has been filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.plans.causal import FOREVER, Known, nearest_open

HORIZON = 96
#: Bars on each side of a turning point, and those that the mean range looks back.
TURN, RANGE_BARS = 2, 14


def first_actionable(known: Known) -> DataFrame:
    """Each setup at the first bar at which it could be acted on: pos, entry, stop, rr and the displacement's end as known there."""
    keys = ["symbol", "formed_pos", "way"]
    taken = known.live_setups().where("actionable").groupBy(*keys).agg(F.min("pos").alias("pos"), F.min_by(F.struct("entry", "stop", "risk", "rr", "sweep_pos", "level_pos"), "pos").alias("x")).select(*keys, "pos", "x.*")
    ends = known.moves.select("symbol", "way", "sweep_pos", "level_pos", "end_price", "known_from", "known_to")
    return taken.join(ends, ["symbol", "way", "sweep_pos", "level_pos"]).where("known_from <= pos and known_to > pos").drop("known_from", "known_to")


def measures(known: Known, horizon: int = HORIZON) -> DataFrame:
    """One row per filled setup: its best move in risks and in mean ranges, where that lies against the displacement and the next swing, and its stalls.

    A setup waits ``horizon`` bars to be filled and lives as many from there.  A
    stall is a stretch from one new extreme (or the fill) to the next (or the end);
    retrace_r is the farthest that price came back from its extreme meanwhile.
    """
    bars = known.bars.select("symbol", F.col("pos").cast("long").alias("bar"), "high", "low", "close")
    line = Window.partitionBy("symbol").orderBy("bar")
    before = F.lag("close").over(line)
    span = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    around, after = line.rowsBetween(-TURN, TURN), line.rowsBetween(1, TURN)
    marked = bars.withColumn("span_", span).withColumn("range", F.avg("span_").over(line.rowsBetween(1 - RANGE_BARS, 0)))
    marked = marked.withColumns({"top": F.max("high").over(around), "bottom": F.min("low").over(around), "next_top": F.max("high").over(after), "next_bottom": F.min("low").over(after)})
    swings = known.legs.select("symbol", "kind", "price", F.col("known_from").alias("confirm_pos"), F.when(F.col("known_to") < FOREVER, F.col("known_to")).alias("hit_pos"))
    trades = nearest_open(first_actionable(known), swings).withColumnRenamed("target", "swing").join(marked.select("symbol", F.col("bar").alias("pos"), "range"), ["symbol", "pos"])
    side = F.col("way").cast("double")
    cell = lambda c: F.floor(c / horizon)
    spread = trades.withColumn("cell_", F.explode(F.sequence(cell(F.col("pos")), cell(F.col("pos") + 2 * horizon))))
    path = spread.join(bars.withColumn("cell_", cell(F.col("bar"))), ["symbol", "cell_"]).where(F.col("bar").between(F.col("pos"), F.col("pos") + 2 * horizon)).drop("cell_", "close")
    own = ["symbol", "formed_pos", "way"]
    trade = Window.partitionBy(*own)
    path = path.withColumn("fill", F.min(F.when((F.col("low") <= F.col("entry")) & (F.col("high") >= F.col("entry")) & (F.col("bar") <= F.col("pos") + horizon), F.col("bar"))).over(trade))
    path = path.where(F.col("bar").between(F.col("fill"), F.col("fill") + horizon))
    path = path.withColumn("gain", side * (F.when(F.col("way") == 1, F.col("high")).otherwise(F.col("low")) - F.col("entry"))).withColumn("dip", side * (F.when(F.col("way") == 1, F.col("low")).otherwise(F.col("high")) - F.col("entry")))
    so_far = trade.orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    path = path.withColumn("best_", F.greatest(F.lit(0.0), F.coalesce(F.max("gain").over(so_far), F.lit(0.0)))).withColumn("new_", F.col("gain") > F.col("best_"))
    path = path.withColumn("mark_", F.when(F.col("new_") | (F.col("bar") == F.col("fill")), F.col("bar"))).withColumn("end", F.max("bar").over(trade))
    since = F.last("mark_", ignorenulls=True).over(trade.orderBy("bar").rowsBetween(Window.unboundedPreceding, -1))
    path = path.withColumn("stall_", F.when(F.col("mark_").isNotNull() | (F.col("bar") == F.col("end")), F.col("bar") - since))
    carried = [c for c in trades.columns if c not in own]
    each = path.groupBy(*own).agg(
        *(F.first(c).alias(c) for c in (*carried, "fill", "end")), F.greatest(F.lit(0.0), F.max("gain")).alias("best"), F.coalesce(F.max(F.when(F.col("new_"), F.col("bar"))), F.first("fill")).alias("best_bar"),
        F.coalesce(F.max("stall_"), F.lit(0)).cast("long").alias("longest_stall"), F.max(F.when(F.col("bar") > F.col("fill"), F.col("best_") - F.col("dip"))).alias("back"),
    )
    turns = marked.select("symbol", F.col("bar").alias("best_bar"), "top", "bottom", "next_top", "next_bottom")
    each = each.join(turns, ["symbol", "best_bar"])
    ahead = lambda c: side * (F.col(c) - F.col("entry"))
    peak, then = F.when(F.col("way") == 1, ahead("top")).otherwise(ahead("bottom")), F.when(F.col("way") == 1, ahead("next_top")).otherwise(ahead("next_bottom"))
    risk, leg = F.col("risk"), side * (F.col("end_price") - F.col("stop"))
    r3 = lambda c, name: F.round(c, 3).alias(name)
    return each.where("risk > 0").select(
        *own, "pos", "fill", "best_bar", "longest_stall", r3(F.col("best") / risk, "mfe_r"), r3(F.col("rr"), "reward_r"), r3(F.abs(leg) / risk, "leg_r"), r3(side * (F.col("entry") - F.col("stop")) / F.when(leg != 0, leg), "entry_share"),
        r3(ahead("end_price") / risk, "to_leg_end_r"), r3(F.when(ahead("end_price") > 0, F.col("best") / ahead("end_price")), "mfe_to_leg_end"), r3(risk / F.when(F.col("range") != 0, F.col("range")), "risk_ranges"),
        r3(F.col("best") / F.when(F.col("range") != 0, F.col("range")), "mfe_ranges"), r3(ahead("swing") / risk, "swing_r"), r3(F.col("back") / risk, "retrace_r"),
        F.when(F.col("best_bar") + TURN <= F.col("end"), (F.col("best") >= peak - 1e-9) & (then < F.col("best") - 1e-9)).alias("turned"),
    )


def report(rows: DataFrame) -> DataFrame:
    """By symbol: how many trades, the share that turned at their extreme, the mean stall, and where the best move ended against the displacement's end."""
    place = F.col("mfe_to_leg_end")
    shares = {"below_end": place < 0.8, "at_end": place.between(0.8, 1.2), "beyond_end": place > 1.2}
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("turned").cast("double"))).alias("turned_percent"), F.round(F.avg("longest_stall"), 6).alias("mean_stall"), *(F.count_if(test).alias(name) for name, test in shares.items()))
