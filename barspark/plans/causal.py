"""What the chain from sweep to setup knew at every bar, by validity intervals.

Each detector's row gets the positions [known_from, known_to) at which the chain,
run on the bars up to there, would have it.  What was known at a bar is then a
look-up of intervals; the chain runs once and no row uses a later bar.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.session import session_day
from barspark.operators import structure as D
from barspark.operators.firsthit import first_beyond
from barspark.operators.joins import as_of
from barspark.operators.ordered import fold
from barspark.plans.setups import EXIT_RISKS, MIN_RR, QUALITY, judged, moved_to, turns
from barspark.sources.shared import written

#: The end of what stays known.
FOREVER = 1 << 40


def known_at(frame: DataFrame, position) -> DataFrame:  # noqa: ANN001
    """The rows that were known at a bar position."""
    return frame.where((F.col("known_from") <= position) & (F.col("known_to") > position))


def legs(pivots: DataFrame) -> DataFrame:
    """Structural swings as they were known: a run's extreme until a more extreme pivot of the run is confirmed."""
    order = Window.partitionBy("symbol").orderBy("pos", "kind")
    changed = (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit(0))).cast("int")
    runs = pivots.withColumn("changed_", changed).withColumn("run", F.sum("changed_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("symbol", "run").orderBy("pos")
    best = F.max(F.col("kind") * F.col("price")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    out = runs.withColumn("best_", best).where("best_ is null or kind * price > best_")
    out = out.withColumn("known_from", F.col("confirm_pos").cast("long")).withColumn("known_to", F.coalesce(F.lead("known_from").over(inside), F.lit(FOREVER)))
    return out.select("symbol", "run", "kind", "pos", "price", "known_from", "known_to")


def moves(pools: DataFrame, minor: DataFrame, bars: DataFrame) -> DataFrame:
    """Displacements that followed swept levels as they were known.

    While no pivot against it is confirmed a displacement goes on to the bar at
    hand, a row for each; from the confirmation on it ends at that pivot.
    """
    going = F.transform(F.sequence(F.col("sweep_pos") + 1, F.coalesce("turn_pos", "last_pos")), lambda c: F.struct(c.alias("end_pos"), F.lit(False).alias("exhausted"), c.alias("known_from"), (c + 1).alias("known_to")))
    ended = F.when(F.col("turn_pos").isNotNull(), F.array(F.struct(F.col("turn_pos").alias("end_pos"), F.lit(True).alias("exhausted"), (F.col("turn_pos") + 1).alias("known_from"), F.lit(FOREVER).alias("known_to"))))
    found = turns(pools, minor, bars).where("sweep_pos < coalesce(turn_pos, last_pos)")
    rows = found.withColumn("e", F.explode(F.concat(going, F.coalesce(ended, F.array())))).select(*found.columns, "e.*")
    # the pivot is confirmed a bar later, which may not have come
    return moved_to(rows.where("known_from <= last_pos"), bars)


def shifts(moved: DataFrame, known: DataFrame, bars: DataFrame) -> DataFrame:
    """Versions of each displacement's structure shift.

    The swing that a shift reverses is the last one before the sweep.  Where its
    run goes on to a more extreme pivot behind the sweep, that swing is no longer
    before it, and the same side's run before takes its place; without one the
    shift ends.  confirm_pos and wick_pos are the bars that close and that pass
    beyond the swing, whenever these come.
    """
    last = known.select("symbol", F.col("kind").alias("way"), "run", F.col("pos").alias("broken_pos"), F.col("price").alias("broken_price"), F.col("known_to").alias("leg_to"))
    first = as_of(moved, last, ["symbol", "way"], "sweep_pos", "broken_pos", ["run", "broken_pos", "broken_price", "leg_to"], strict=True).where("broken_pos is not null")
    before = last.where(F.col("leg_to") == FOREVER).select("symbol", (F.col("run") + 2).alias("run"), F.col("broken_pos").alias("old_pos"), F.col("broken_price").alias("old_price"))
    both = first.join(before, ["symbol", "run"], "left")
    versions = F.array(
        F.struct(F.col("broken_pos"), F.col("broken_price"), F.col("known_from"), F.least("known_to", "leg_to").alias("known_to")),
        F.struct(F.col("old_pos").alias("broken_pos"), F.col("old_price").alias("broken_price"), F.greatest("known_from", "leg_to").alias("known_from"), F.col("known_to")),
    )
    own = ["symbol", "level_pos", "way", "price", "extreme", "sweep_pos", "end_pos", "exhausted"]
    out = both.select(*own, F.explode(versions).alias("v")).select(*own, "v.*").where("broken_pos is not null and known_from < known_to")
    points = out.withColumn("side", F.col("way")).withColumn("level", F.col("broken_price"))
    closed = first_beyond(points, bars, "sweep_pos", up="close", down="close").withColumnRenamed("hit_pos", "confirm_pos")
    return first_beyond(closed, bars, "sweep_pos").withColumnRenamed("hit_pos", "wick_pos").drop("side", "level")


def gaps(shifted: DataFrame, bars: DataFrame) -> DataFrame:
    """Fair value gaps with the displacement that owned each, by interval, and the bars that touch and mitigate it.

    A gap inside several displacements belongs, at each bar, to the earliest sweep
    among those that are known then.
    """
    found = D.gap_shapes(bars).select("symbol", F.col("pos").alias("formed_pos"), "way", "bottom", "top")
    alive = shifted.groupBy("symbol", "level_pos", "way", "sweep_pos", "end_pos", "extreme").agg(F.min("known_from").alias("known_from"), F.max("known_to").alias("known_to"))
    inside = alive.where("end_pos >= sweep_pos + 2").withColumn("formed_pos", F.explode(F.sequence(F.col("sweep_pos") + 2, F.col("end_pos"))))
    owned = inside.join(found, ["symbol", "formed_pos", "way"])
    keys = ["symbol", "formed_pos", "way"]
    # candidates of one interval are one: the earliest sweep's
    owned = owned.groupBy(*keys, "bottom", "top", "known_from", "known_to").agg(F.min(F.struct("sweep_pos", "level_pos", "extreme")).alias("owner"))
    cuts = owned.select(*keys, F.explode(F.array("known_from", "known_to")).alias("cut_from")).distinct()
    cuts = cuts.withColumn("cut_to", F.lead("cut_from").over(Window.partitionBy(*keys).orderBy("cut_from"))).where("cut_to is not null")
    pieces = owned.join(cuts, keys).where("cut_from >= known_from and cut_to <= known_to")
    pieces = pieces.groupBy(*keys, "bottom", "top", F.col("cut_from").alias("known_from"), F.col("cut_to").alias("known_to")).agg(F.min("owner").alias("owner")).select("*", "owner.*").drop("owner")
    middle = (F.col("top") + F.col("bottom")) / 2
    each = pieces.select(*keys, "bottom", "top").distinct().withColumn("middle", middle).withColumn("side", -F.col("way"))
    touched = first_beyond(each.withColumn("level", F.col("middle")), bars, "formed_pos", strict=False).withColumnRenamed("hit_pos", "touch_pos")
    far = F.when(F.col("way") == 1, F.col("bottom")).otherwise(F.col("top"))
    states = first_beyond(touched.withColumn("level", far), bars, "formed_pos", up="close", down="close").withColumnRenamed("hit_pos", "mitigated_pos")
    return pieces.drop("bottom", "top").join(states.drop("side", "level"), keys)


def nearest_open(asked: DataFrame, pools: DataFrame) -> DataFrame:
    """For rows (symbol, pos, way, entry, ...) the nearest level beyond the entry that was confirmed and not yet passed at ``pos``.

    Levels open at their confirmation and close when a bar passes them; they wait
    in order of price, so a row finds its neighbour by bisection and a task holds
    open levels alone.
    """
    own = [c for c in asked.columns if c != "symbol"]
    line = asked.select("symbol", F.col("pos").alias("line_"), F.lit(2).alias("what_"), F.col("way").alias("way_"), F.col("entry").alias("price_"), *own)
    opened = pools.select("symbol", F.col("confirm_pos").alias("line_"), F.lit(0).alias("what_"), F.col("kind").alias("way_"), F.col("price").alias("price_"))
    closed = pools.where("hit_pos is not null").select("symbol", F.col("hit_pos").alias("line_"), F.lit(1).alias("what_"), F.col("kind").alias("way_"), F.col("price").alias("price_"))
    line = line.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)

    def step(state: dict, part: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        what, way, price = part["what_"].to_numpy(), part["way_"].to_numpy(), part["price_"].to_numpy(float)
        target = [None] * len(part)
        for i in range(len(part)):
            levels = state[int(way[i])]
            if what[i] == 0:
                bisect.insort(levels, price[i])
            elif what[i] == 1:
                del levels[bisect.bisect_left(levels, price[i])]
            else:
                at = bisect.bisect_right(levels, price[i]) if way[i] > 0 else bisect.bisect_left(levels, price[i]) - 1
                target[i] = levels[at] if 0 <= at < len(levels) else None
        rows = part.loc[what == 2, ["symbol", *own]].copy()
        rows["target"] = pd.Series(target, index=part.index, dtype=float)[what == 2]
        return state, rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select("symbol", *own).schema.fields) + ", target double"
    out = fold(line, ["line_", "what_"], lambda: {1: [], -1: []}, step, schema)
    return out.withColumn("target", F.nanvl("target", F.lit(None).cast("double")))


def latest_shift(shifted: DataFrame, bars: DataFrame) -> DataFrame:
    """For each bar and way the position of the newest structure shift known there: its confirmation, or before that its broken swing."""
    spans = F.array(
        F.struct(F.col("broken_pos").cast("long").alias("at"), F.col("known_from"), F.least("known_to", F.coalesce("confirm_pos", F.lit(FOREVER))).alias("known_to")),
        F.struct(F.col("confirm_pos").cast("long").alias("at"), F.greatest("known_from", "confirm_pos").alias("known_from"), F.when(F.col("confirm_pos").isNotNull(), F.col("known_to")).alias("known_to")),
    )
    spans = shifted.select("symbol", "way", F.explode(spans).alias("s")).select("symbol", "way", "s.*").where("known_from < known_to")
    line = bars.select("symbol", F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"), F.col("pos").cast("long").alias("known_from"))
    # what stays known is a running maximum; what ends, a swing's run still going on, is short and laid out bar by bar
    kept = spans.where(F.col("known_to") == FOREVER).select("symbol", "way", "known_from", "at")
    over = Window.partitionBy("symbol", "way").orderBy("known_from").rangeBetween(Window.unboundedPreceding, 0)
    lasting = line.withColumn("bar_", F.lit(True)).unionByName(kept, allowMissingColumns=True).withColumn("at", F.max("at").over(over)).where("bar_")
    passing = spans.where(F.col("known_to") < FOREVER).select("symbol", "way", "at", F.explode(F.sequence("known_from", F.col("known_to") - 1)).alias("known_from"))
    both = lasting.select("symbol", "way", "known_from", "at").unionByName(passing.select("symbol", "way", "known_from", "at"))
    return both.groupBy("symbol", "way", F.col("known_from").alias("pos")).agg(F.max("at").alias("newest"))


class Known:
    """The chain's rows with their intervals, each written once."""

    def __init__(self, bars: DataFrame):
        self.bars = written(bars, "bars")
        pivots = written(D.pivots(self.bars), "pivots")
        self.pools = written(D.pools(pivots, self.bars), "pools")
        self.legs = written(legs(pivots), "legs")
        self.moves = written(moves(self.pools, D.pivots(self.bars, 1), self.bars), "moves")
        self.shifts = written(shifts(self.moves, self.legs, self.bars), "shifts")
        self.gaps = written(gaps(self.shifts, self.bars), "gaps")

    def live_setups(self) -> DataFrame:
        """Every bar's setups whose gap is not mitigated yet: entry, stop, target, risk, rr, reject, status and the shift's position.

        Mitigated setups can never be acted on again and are left to the counts.
        """
        last = self.bars.groupBy("symbol").agg(F.max("pos").cast("long").alias("last_pos"))
        until = F.least(F.col("known_to"), F.coalesce("mitigated_pos", F.lit(FOREVER)), F.col("last_pos") + 1)
        live = self.gaps.join(last, "symbol").withColumn("until_", until).where("known_from < until_")
        asked = live.select("symbol", "formed_pos", "way", "sweep_pos", "level_pos", F.col("middle").alias("entry"), F.col("extreme").alias("stop"), "touch_pos", F.explode(F.sequence("known_from", F.col("until_") - 1)).alias("pos"))
        out = nearest_open(asked, self.pools)
        out = out.withColumn("risk", F.abs(F.col("stop") - F.col("entry"))).withColumn("reward", F.coalesce(F.abs(F.col("entry") - F.col("target")), F.lit(0.0)))
        out = out.withColumn("rr", F.when(F.col("risk") > 0, F.round(F.col("reward") / F.col("risk"), 2)).otherwise(0.0))
        wrong = ((F.col("way") == -1) & (F.col("entry") >= F.col("stop"))) | ((F.col("way") == 1) & (F.col("entry") <= F.col("stop")))
        reject = F.when(wrong, "entry beyond the extreme").when(F.col("target").isNull(), "no target").when(F.col("rr") < MIN_RR, "reward too small").otherwise("")
        status = F.when(F.col("touch_pos") <= F.col("pos"), "touched").otherwise("unfilled")
        return out.withColumn("reject", reject).withColumn("status", status).withColumn("actionable", F.col("reject") == "")

    def lifecycle(self, live: DataFrame) -> DataFrame:
        """Live setups with ``state`` at each bar: historical if superseded by a newer opposite shift or from another session, else current or active."""
        newest = latest_shift(self.shifts, self.bars).withColumn("way", -F.col("way"))
        own = self.shifts.select("symbol", "level_pos", "way", "sweep_pos", "known_from", "known_to", "confirm_pos", "broken_pos")
        rows = live.join(own, ["symbol", "level_pos", "way", "sweep_pos"]).where("pos >= known_from and pos < known_to").drop("known_from", "known_to")
        at = F.when(F.col("confirm_pos") <= F.col("pos"), F.col("confirm_pos")).otherwise(F.col("broken_pos"))
        days = self.bars.select("symbol", F.col("pos").cast("long").alias("pos"), session_day(F.col("ts")).alias("day"))
        rows = rows.join(newest, ["symbol", "way", "pos"], "left").join(days, ["symbol", "pos"])
        rows = rows.join(days.withColumnRenamed("pos", "sweep_pos").withColumnRenamed("day", "sweep_day"), ["symbol", "sweep_pos"])
        past = F.coalesce(F.col("newest") > at, F.lit(False)) | F.coalesce(F.col("sweep_day") != F.col("day"), F.lit(False))
        return rows.withColumn("state", F.when(past, "historical").when(F.col("actionable"), "current").otherwise("active"))

    def states(self) -> DataFrame:
        """A row per bar with what was known there: counts of open levels, sweeps, displacements, shifts and gaps, and the dealing range."""
        spans = {
            "n_pools": self.pools.select("symbol", F.col("confirm_pos").cast("long").alias("known_from"), F.coalesce("hit_pos", F.lit(FOREVER)).alias("known_to")),
            "n_sweeps": self.pools.where("swept").select("symbol", F.col("hit_pos").alias("known_from"), F.lit(FOREVER).alias("known_to")),
            "n_displacements": self.moves.select("symbol", "known_from", "known_to"),
            "n_shifts": self.shifts.select("symbol", "known_from", "known_to"),
            "n_gaps": self.gaps.select("symbol", "known_from", "known_to"),
        }
        events = None
        for name, frame in spans.items():
            edges = F.array(F.struct(F.col("known_from").alias("pos"), F.lit(1).alias("n")), F.struct(F.col("known_to").alias("pos"), F.lit(-1).alias("n")))
            part = frame.select("symbol", F.lit(name).alias("what"), F.explode(edges).alias("e")).select("symbol", "what", "e.*")
            events = part if events is None else events.unionByName(part)
        total = events.groupBy("symbol", "pos").agg(*(F.sum(F.when(F.col("what") == name, F.col("n")).otherwise(0)).alias(name) for name in spans))
        line = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        cursors = self.bars.select("symbol", F.col("pos").cast("long").alias("pos"), "close").join(total, ["symbol", "pos"], "left")
        out = cursors.select("symbol", "pos", "close", *(F.coalesce(F.sum(name).over(line), F.lit(0)).alias(name) for name in spans))
        for kind, name in ((1, "range_high"), (-1, "range_low")):
            side = self.legs.where(F.col("kind") == kind).select("symbol", "known_from", F.col("price").alias(name))
            out = as_of(out, side, ["symbol"], "pos", "known_from", [name])
        return out

    def decisions(self) -> DataFrame:
        """A row per bar: LONG, SHORT or NO-TRADE by the best current setup, that setup, and how many were live, actionable and current."""
        rows = self.lifecycle(self.live_setups())
        order = F.struct((-F.col("rr")).alias("a"), F.round("risk", 2).alias("b"), F.col("formed_pos"), F.col("way"))
        current = F.col("state") == "current"
        best = F.min_by(F.when(current, F.struct("formed_pos", "way", "entry", "stop", "target", "rr")), F.when(current, order)).alias("best")
        each = rows.groupBy("symbol", "pos").agg(F.count("*").alias("n_live"), F.count_if("actionable").alias("n_actionable"), F.count_if(current).alias("n_current"), best)
        out = self.bars.select("symbol", F.col("pos").cast("long").alias("pos")).join(each, ["symbol", "pos"], "left").select("symbol", "pos", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_actionable", "n_current")), "best.*")
        return out.withColumn("decision", F.when(F.col("way") == 1, "LONG").when(F.col("way") == -1, "SHORT").otherwise("NO-TRADE"))

    def tickets(self, timeframe: str, threshold: float = QUALITY) -> DataFrame:
        """A ticket for every bar: what to do by the best current setup, where to get in and out, and what speaks against it.

        ``action`` is TAKE if the setup's quality in the dealing range known at the bar
        reaches the threshold, SKIP if not or without a range, NO_SETUP without a
        current setup; prices are null then.  ``exit_target`` lies EXIT_RISKS risks
        beyond the entry; the open level that the setup aims at stays beside it.
        ``issues`` names the scores below a half, the worst first.
        """
        ranges = self.states().select("symbol", "pos", "range_high", "range_low")
        times = self.bars.select("symbol", F.col("pos").cast("long").alias("pos"), F.col("ts"))
        rows = judged(self.decisions().join(ranges, ["symbol", "pos"]).join(times, ["symbol", "pos"]), threshold)
        some = F.col("way").isNotNull()
        ranged = some & F.col("range_high").isNotNull() & F.col("range_low").isNotNull()
        risk = F.abs(F.col("entry") - F.col("stop"))
        poor = {c: F.when(F.col(c) < 0.5, c) for c in ("pd_location", "ce_distance")}
        first = F.col("pd_location") <= F.col("ce_distance")
        issues = F.when(first, F.concat_ws(",", poor["pd_location"], poor["ce_distance"])).otherwise(F.concat_ws(",", poor["ce_distance"], poor["pd_location"]))
        return rows.select(
            "symbol", "pos", F.concat_ws(":", "symbol", F.lit(timeframe), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("ticket"), "decision",
            F.when(~some, "NO_SETUP").when(ranged & (F.col("verdict") == "TRADE"), "TAKE").otherwise("SKIP").alias("action"),
            F.when(ranged, F.col("verdict")).otherwise("N/A").alias("execution"), F.when(ranged, F.col("quality")).otherwise(0.0).alias("confidence"),
            F.when(ranged, F.col("weakest")).otherwise("").alias("weakest"), F.when(ranged, issues).otherwise("").alias("issues"),
            "entry", "stop", F.round(risk, 4).alias("risk"), F.round(F.col("entry") + F.col("way") * EXIT_RISKS * risk, 4).alias("exit_target"), "target", "rr",
        )
