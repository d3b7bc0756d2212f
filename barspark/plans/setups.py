"""The chain from a swept level to a trade setup, as joins over bars and pivots.

sweep -> displacement (to the first later counter pivot) -> structure shift (close
beyond the last structural swing before the sweep) -> fair value gap inside the
displacement -> setup (entry at the gap's middle, stop at the sweep's extreme,
target at the nearest open level on the other side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.session import session_day
from barspark.operators import structure as D
from barspark.operators.firsthit import first_beyond
from barspark.operators.joins import as_of

MIN_RR = 3.0


def turns(pools: DataFrame, minor: DataFrame, bars: DataFrame) -> DataFrame:
    """Swept levels with turn_pos, the first later pivot against the move that follows (null while there is none), and the symbol's last_pos."""
    opposite = minor.select("symbol", (-F.col("kind")).alias("kind"), F.col("pos").alias("turn_pos"))
    after = pools.where("swept").withColumn("from_pos", F.col("hit_pos") + 1)
    met = as_of(after, opposite, ["symbol", "kind"], "from_pos", "turn_pos", ["turn_pos"], forward=True)
    last = bars.groupBy("symbol").agg(F.max("pos").alias("last_pos"))
    return met.join(last, "symbol").select("symbol", F.col("pos").alias("level_pos"), (-F.col("kind")).alias("way"), "price", "extreme", F.col("hit_pos").alias("sweep_pos"), F.col("turn_pos").cast("long").alias("turn_pos"), F.col("last_pos").cast("long").alias("last_pos"))


def moved_to(ended: DataFrame, bars: DataFrame) -> DataFrame:
    """Displacements with end_price and net_move at their end_pos; those that went nowhere are none."""
    at = bars.select("symbol", F.col("pos").cast("long").alias("end_pos"), F.col("high").alias("end_high"), F.col("low").alias("end_low"))
    out = ended.where("end_pos > sweep_pos").join(at, ["symbol", "end_pos"]).withColumn("end_price", F.when(F.col("way") == 1, F.col("end_high")).otherwise(F.col("end_low")))
    return out.withColumn("net_move", F.col("way") * (F.col("end_price") - F.col("extreme"))).where("net_move > 0").drop("end_high", "end_low", "turn_pos", "last_pos")


def moves(bars: DataFrame) -> DataFrame:
    """Swept levels with the displacement that followed: sweep_pos, way (1 up, -1 down), extreme, end_pos, end_price, level_pos.

    A displacement ends at the first pivot against it (``exhausted``) or is still
    going on at the last bar.
    """
    found = turns(D.pools(D.pivots(bars), bars), D.pivots(bars, 1), bars)
    return moved_to(found.withColumn("end_pos", F.coalesce("turn_pos", "last_pos")).withColumn("exhausted", F.col("turn_pos").isNotNull()), bars)


def shifts(bars: DataFrame) -> DataFrame:
    """Displacements with the structural swing they reverse and how far that went.

    state: confirmed (a close beyond it, at confirm_pos), candidate (a wick
    only), potential; without an earlier swing there is no row.
    """
    # a move up reverses a structural high, one down a low
    legs = D.skeleton(D.pivots(bars)).select("symbol", F.col("kind").alias("way"), F.col("pos").alias("broken_pos"), F.col("price").alias("broken_price"))
    before = as_of(moves(bars), legs, ["symbol", "way"], "sweep_pos", "broken_pos", ["broken_pos", "broken_price"], strict=True).where("broken_pos is not null")
    points = before.withColumn("side", F.col("way")).withColumn("level", F.col("broken_price"))
    closed = first_beyond(points, bars, "sweep_pos", up="close", down="close", carry=("close",)).withColumnRenamed("hit_pos", "confirm_pos").withColumnRenamed("hit_close", "confirm_close")
    wicked = first_beyond(closed, bars, "sweep_pos").withColumnRenamed("hit_pos", "wick_pos").drop("side", "level")
    state = F.when(F.col("confirm_pos").isNotNull(), "confirmed").when(F.col("wick_pos").isNotNull(), "candidate").otherwise("potential")
    acceptance = F.coalesce(F.abs(F.col("broken_price") - F.col("confirm_close")), F.lit(0.0))
    return wicked.withColumn("state", state).withColumn("acceptance", acceptance).drop("confirm_close", "wick_pos")


def imbalances(bars: DataFrame, moved: DataFrame) -> DataFrame:
    """Fair value gaps inside displacements, each once (the earliest sweep's), with their state.

    touched: a bar came back to the middle; mitigated: one closed beyond the far
    side; ``touch_pos`` counts only up to the latter.
    """
    found = D.gap_shapes(bars).select("symbol", F.col("pos").alias("formed_pos"), "way", "bottom", "top")
    inside = moved.where("end_pos >= sweep_pos + 2").withColumn("formed_pos", F.explode(F.sequence(F.col("sweep_pos") + 2, F.col("end_pos"))))
    first = Window.partitionBy("symbol", "formed_pos", "way").orderBy("sweep_pos", "level_pos")
    gaps = inside.join(found, ["symbol", "formed_pos", "way"]).withColumn("at_", F.row_number().over(first)).where("at_ = 1").drop("at_")
    return gap_states(gaps, bars)


def gap_states(gaps: DataFrame, bars: DataFrame) -> DataFrame:
    """Gaps (formed_pos, way, bottom, top) with their middle, touch_pos, mitigated_pos and status."""
    gaps = gaps.withColumn("middle", (F.col("top") + F.col("bottom")) / 2).withColumn("side", -F.col("way"))
    touched = first_beyond(gaps.withColumn("level", F.col("middle")), bars, "formed_pos", strict=False).withColumnRenamed("hit_pos", "touch_pos")
    far = F.when(F.col("way") == 1, F.col("bottom")).otherwise(F.col("top"))
    out = first_beyond(touched.withColumn("level", far), bars, "formed_pos", up="close", down="close").withColumnRenamed("hit_pos", "mitigated_pos").drop("side", "level")
    out = out.withColumn("touch_pos", F.when(F.col("mitigated_pos").isNull() | (F.col("touch_pos") <= F.col("mitigated_pos")), F.col("touch_pos")))
    return out.withColumn("status", F.when(F.col("mitigated_pos").isNotNull(), "mitigated").when(F.col("touch_pos").isNotNull(), "touched").otherwise("unfilled"))


def ranked_shifts(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Structure shifts ranked by state, a dominant broken swing, acceptance and recency; on ties earlier sweeps first, moves down before moves up."""
    legs = D.skeleton(D.pivots(bars)).select("symbol", F.col("kind").alias("way"), F.col("pos").alias("broken_pos"), F.col("dominant").cast("int").alias("f_dominant"))
    state = F.when(F.col("state") == "confirmed", 2).when(F.col("state") == "candidate", 1).otherwise(0)
    keyed = found.join(legs, ["symbol", "way", "broken_pos"]).withColumn("f_state", state).withColumn("place_", F.struct("sweep_pos", "level_pos", "way"))
    return D.ranked(keyed, ["symbol"], ["f_state", "f_dominant", "acceptance", "broken_pos"], "place_").drop("place_")


def refined_gaps(ranked: DataFrame, coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Entry gaps on a lower timeframe, each owned by the best ranked shift of its way whose window was open.

    A shift opens a window on the fine bars when its sweep's bar opens, and it never
    closes.  Openings and gaps lie on one time line along which the best rank so
    far is carried, so a gap meets one owner and no window is laid out.
    """
    opened = ranked.join(coarse.select("symbol", F.col("pos").alias("sweep_pos"), F.col("ts").alias("line_")), ["symbol", "sweep_pos"])
    owner = F.struct("rank", "sweep_pos", "level_pos", "extreme").alias("owner")
    shapes = D.gap_shapes(fine).withColumn("gap_", F.struct(F.col("pos").alias("formed_pos"), "ts", "bottom", "top"))
    # an opening comes before a gap that starts with it
    line = opened.select("symbol", "way", "line_", F.lit(0).alias("side_"), owner).unionByName(shapes.select("symbol", "way", F.col("start_ts").alias("line_"), F.lit(1).alias("side_"), "gap_"), allowMissingColumns=True)
    so_far = Window.partitionBy("symbol", "way").orderBy("line_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    owned = line.withColumn("owner", F.min("owner").over(so_far)).where("gap_ is not null and owner is not null")
    return gap_states(owned.select("symbol", "way", "gap_.*", "owner.*"), fine)


def setups(bars: DataFrame, least_stop: float | None = None) -> DataFrame:
    """A row per fair value gap: entry, stop, target, risk, reward, rr and why it is not actionable, if so.

    The target is the nearest level that no bar has passed yet, below a short's
    entry or above a long's.
    """
    gaps = imbalances(bars, shifts(bars)).withColumn("entry", F.col("middle")).withColumn("stop", F.col("extreme"))
    open_ = D.pools(D.pivots(bars), bars).where("hit_pos is null").select("symbol", F.col("kind").alias("way"), F.col("price").alias("target")).distinct()
    columns = ["target"]
    longs = as_of(gaps.where("way = 1"), open_.where("way = 1").withColumn("p_", F.col("target")), ["symbol", "way"], "entry", "p_", columns, forward=True, strict=True)
    shorts = as_of(gaps.where("way = -1"), open_.where("way = -1").withColumn("p_", F.col("target")), ["symbol", "way"], "entry", "p_", columns, strict=True)
    out = longs.unionByName(shorts)
    out = out.withColumn("risk", F.abs(F.col("stop") - F.col("entry"))).withColumn("reward", F.coalesce(F.abs(F.col("entry") - F.col("target")), F.lit(0.0)))
    out = out.withColumn("rr", F.when(F.col("risk") > 0, F.round(F.col("reward") / F.col("risk"), 2)).otherwise(0.0))
    return out.withColumn("reject", reject_reason(least_stop)).withColumn("actionable", F.col("reject") == "")


def reject_reason(least_stop: float | None):
    """The first rule that a setup breaks; empty if none."""
    small = F.lit(False) if least_stop is None else F.col("risk") < least_stop
    wrong = ((F.col("way") == -1) & (F.col("entry") >= F.col("stop"))) | ((F.col("way") == 1) & (F.col("entry") <= F.col("stop")))
    return F.when(small, "stop too near").when(F.col("status") == "mitigated", "gap mitigated").when(wrong, "entry beyond the extreme").when(F.col("target").isNull(), "no target").when(F.col("rr") < MIN_RR, "reward too small").otherwise("")


def ranked_setups(found: DataFrame) -> DataFrame:
    """Setups by actionable, then reward by risk, then nearness of the stop; ``tied`` where all three are equal; ``lost_by``: the factor that decided against the one above."""
    factors = {"actionable": F.col("actionable").cast("int"), "rr": F.col("rr"), "tight": -F.round("risk", 2)}
    keyed = found.withColumns({f"f_{n}": c for n, c in factors.items()})
    order = Window.partitionBy("symbol").orderBy(*(F.col(f"f_{n}").desc() for n in factors), "formed_pos", "way")
    above = {n: F.lag(f"f_{n}").over(order) for n in factors}
    lost = F.when(F.row_number().over(order) == 1, "")
    for n in factors:
        lost = lost.when(above[n] != F.col(f"f_{n}"), n)
    tied = F.count(F.lit(1)).over(Window.partitionBy("symbol", *(f"f_{n}" for n in factors))) > 1
    return keyed.withColumn("rank", F.row_number().over(order)).withColumn("tied", tied).withColumn("lost_by", lost.otherwise("tie")).drop(*(f"f_{n}" for n in factors))


def recommendations(ranked: DataFrame, symbols: DataFrame) -> DataFrame:
    """LONG, SHORT or NO-TRADE for each symbol: its best actionable setup."""
    best = ranked.where("actionable").groupBy("symbol").agg(F.min_by(F.struct("way", "entry", "stop", "target", "rr"), "rank").alias("x")).select("symbol", "x.*")
    out = symbols.select("symbol").distinct().join(best, "symbol", "left")
    return out.withColumn("decision", F.when(F.col("way") == 1, "LONG").when(F.col("way") == -1, "SHORT").otherwise("NO-TRADE"))


def sweep_records(bars: DataFrame) -> DataFrame:
    """A row per swept level: its ranking with the factor that lost to the one above, how many compete, and where the last close lies in the dealing range.

    Factors: a dominant swing was swept, on the right side of the range's middle
    (none without a range), how much of the wick beyond the level the close took
    back, the later sweep.  Without a range that has a height, location and zone are
    null.
    """
    pivots = D.pivots(bars)
    legs = D.skeleton(pivots)
    swept = D.pools(pivots, bars).where("swept")
    strong = legs.select("symbol", "pos", "kind", F.col("dominant").cast("int").alias("f_dominant"))
    ranges = D.dealing_range(legs).select("symbol", "range_high", "range_low", "equilibrium")
    last = bars.groupBy("symbol").agg(F.max_by("close", "pos").alias("last_close"))
    rows = swept.join(strong, ["symbol", "pos", "kind"], "left").join(ranges, "symbol", "left").join(last, "symbol")
    back = F.col("kind") * (F.col("price") - F.col("hit_close"))
    rows = rows.withColumns({
        "f_dominant": F.coalesce("f_dominant", F.lit(0)), "f_aligned": F.coalesce((F.col("kind") * F.col("price") > F.col("kind") * F.col("equilibrium")).cast("int"), F.lit(0)),
        "f_rejection": F.round(F.greatest(back, F.lit(0.0)) / (F.abs(F.col("extreme") - F.col("price")) + 1e-9), 3), "penetration": F.round(F.abs(F.col("extreme") - F.col("price")), 4), "place_": F.struct("pos", "kind"),
    })
    factors = ["f_dominant", "f_aligned", "f_rejection", "hit_pos"]
    order = Window.partitionBy("symbol").orderBy(*(F.col(c).desc() for c in factors), "place_")
    lost = F.when(F.row_number().over(order) == 1, "")
    for c, name in zip(factors, ("dominant", "aligned", "rejection", "recency")):
        lost = lost.when(F.lag(c).over(order) != F.col(c), name)
    ranked = D.ranked(rows, ["symbol"], factors, "place_").withColumn("lost_by", lost.otherwise("tie"))
    some = F.col("range_high") > F.col("range_low")
    zone = F.when(F.col("last_close") > F.col("equilibrium"), "premium").when(F.col("last_close") < F.col("equilibrium"), "discount").otherwise("equilibrium")
    ranked = ranked.withColumn("location", F.when(some, F.round((F.col("last_close") - F.col("range_low")) / (F.col("range_high") - F.col("range_low")), 4))).withColumn("zone", F.when(some, zone))
    competing = swept.groupBy("symbol").agg(F.count("*").alias("competing"))
    return ranked.join(competing, "symbol").withColumn("way", -F.col("kind")).withColumnsRenamed({"pos": "level_pos", "hit_pos": "sweep_pos"}).drop("place_")


def lifecycle(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Setups as current, active or historical (mitigated, superseded by a later opposite shift, or from an earlier session)."""
    at = F.coalesce("confirm_pos", "broken_pos")
    latest = shifts(bars).groupBy("symbol", (-F.col("way")).alias("way")).agg(F.max(at).alias("against"))
    days = bars.select("symbol", F.col("pos").alias("sweep_pos"), session_day(F.col("ts")).alias("sweep_day"))
    now = bars.groupBy("symbol").agg(session_day(F.max("ts")).alias("now_day"))
    out = found.join(latest, ["symbol", "way"], "left").join(days, ["symbol", "sweep_pos"]).join(now, "symbol")
    expired = F.coalesce(F.col("sweep_day") != F.col("now_day"), F.lit(False))
    state = F.when(F.col("status") == "mitigated", "historical").when(F.coalesce(F.col("against") > at, F.lit(False)), "historical").when(expired, "historical").when(F.col("actionable"), "current").otherwise("active")
    return out.withColumn("state", state)


#: What a setup's quality must reach to be traded, and the risks at which a traded one is closed with a gain.
QUALITY, EXIT_RISKS = 0.39, 2.0


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def range_span() -> Column:
    span = F.col("range_high") - F.col("range_low")
    return F.when(span != 0, span).otherwise(1e-9)


def judged(rows: DataFrame, threshold: float = QUALITY) -> DataFrame:
    """Rows with way, entry, range_high and range_low, scored by where the entry lies in the range: pd_location, ce_distance, quality, weakest and verdict."""
    ce = (F.col("range_high") + F.col("range_low")) / 2
    some = lambda c: F.when(c != 0, c).otherwise(1e-9)
    place = F.when(F.col("way") == 1, (ce - F.col("entry")) / some(ce - F.col("range_low"))).otherwise((F.col("entry") - ce) / some(F.col("range_high") - ce))
    rows = rows.withColumns({"pd_location": F.round(clamp(place), 4), "ce_distance": F.round(clamp(1 - F.abs(F.col("entry") - ce) / (0.5 * range_span())), 4)})
    quality = F.round(0.6 * F.col("pd_location") + 0.4 * F.col("ce_distance"), 4)
    weakest = F.when(F.col("pd_location") <= F.col("ce_distance"), "pd_location").otherwise("ce_distance")
    return rows.withColumn("quality", quality).withColumn("weakest", weakest).withColumn("verdict", F.when(F.col("quality") >= threshold, "TRADE").otherwise("PASS"))


def execution_quality(found: DataFrame, ranges: DataFrame, threshold: float = QUALITY) -> DataFrame:
    """Five scores between 0 and 1 of each setup in its symbol's dealing range, and the verdict on two of them."""
    rows = found.join(ranges.select("symbol", "range_high", "range_low"), "symbol")
    span = range_span()
    realism = F.when(F.col("rr").between(3.0, 8.0), 1.0).when(F.col("rr") > 8, clamp(1 - (F.col("rr") - 8) / 24)).otherwise(clamp(F.col("rr") / 3))
    shift = F.when(F.col("state") == "confirmed", 1.0).when(F.col("state") == "candidate", 0.6).otherwise(0.2)
    rejection = clamp(F.abs(F.col("extreme") - F.col("price")) / (0.25 * span))
    status = F.when(F.col("status") == "unfilled", 1.0).when(F.col("status") == "touched", 0.6).otherwise(0.0)
    size = clamp(1 - F.abs((F.col("top") - F.col("bottom")) / span - 0.05) / 0.15)
    rows = rows.withColumns({
        "rr_realism": F.round(realism, 4), "confirmation": F.round(clamp(0.5 * shift + 0.3 * F.when(F.col("exhausted"), 1.0).otherwise(0.5) + 0.2 * rejection), 4), "fvg_location": F.round(clamp(0.7 * status + 0.3 * size), 4),
    })
    return judged(rows, threshold)


def node(kind: str, *parts):  # noqa: ANN002, ANN201
    """Name of an object of the chain."""
    return F.concat_ws(":", F.lit(kind), "symbol", *(F.col(p) if isinstance(p, str) else p for p in parts))


def dependencies(bars: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (symbol, child, parent) of all that the chain found: setup, gap, shift, displacement, sweep, level, swing.

    A setup depends on its gap, shift and sweep and on the open levels at its
    target; a gap on its displacement and shift; a shift on its displacement and
    the swing that it reverses.
    """
    pools = D.pools(D.pivots(bars), bars).withColumnRenamed("pos", "level_pos").withColumn("way", -F.col("kind"))
    level, swing = node("level", "level_pos", "kind"), node("swing", "level_pos", "kind")
    broken = node("swing", "broken_pos", F.col("way"))
    targets = pools.where("hit_pos is null").select("symbol", F.col("kind").alias("way"), F.col("price").alias("target"), level.alias("parent"))
    own = {k: node(k, "level_pos", "way") for k in ("sweep", "move", "shift")}
    gap, setup = node("gap", "formed_pos", "way"), node("setup", "formed_pos", "way")
    edge = lambda frame, *pairs: frame.select("symbol", F.explode(F.array(*(F.struct(a.alias("child"), b.alias("parent")) for a, b in pairs))).alias("e")).select("symbol", "e.*")
    parts = [
        edge(pools, (level, swing)), edge(pools.where("swept"), (own["sweep"], level)), edge(moves(bars), (own["move"], own["sweep"])),
        edge(shifts(bars), (own["shift"], own["move"]), (own["shift"], broken)),
        edge(found, (gap, own["move"]), (gap, own["shift"]), (setup, gap), (setup, own["shift"]), (setup, own["sweep"])),
        found.join(targets, ["symbol", "way", "target"]).select("symbol", setup.alias("child"), "parent"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def object_states(bars: DataFrame, lived: DataFrame, edges: DataFrame) -> DataFrame:
    """Every object as current, active or historical: what a current setup depends on is current, what else an active one does is active."""
    seeds = lived.where("state in ('current', 'active')").select(F.col("state").alias("root"), node("setup", "formed_pos", "way").alias("node"))
    reached = D.ancestors(edges, seeds).groupBy(F.col("node").alias("object")).agg(F.min(F.when(F.col("root") == "current", 0).otherwise(1)).alias("tier"))
    swings = D.skeleton(D.pivots(bars)).select("symbol", node("swing", "pos", "kind").alias("object"))
    objects = edges.select("symbol", F.explode(F.array("child", "parent")).alias("object")).unionByName(swings).distinct()
    state = F.when(F.col("tier") == 0, "current").when(F.col("tier") == 1, "active").otherwise("historical")
    return objects.join(reached, "object", "left").select("symbol", "object", state.alias("state"))


def state_counts(lived: DataFrame, objects: DataFrame) -> DataFrame:
    """Setups and objects of each state by symbol."""
    count = lambda frame, name: frame.groupBy("symbol").agg(*(F.count_if(F.col("state") == s).alias(f"{s}_{name}") for s in ("current", "active", "historical")))
    names = [f"{s}_setups" for s in ("current", "active", "historical")]
    return count(objects, "objects").join(count(lived, "setups"), "symbol", "left").fillna(0, names)


def looked_up(edges: DataFrame) -> DataFrame:
    """The gap, shift and sweep that each setup depends on, found by the kinds of its dependencies."""
    kind = F.substring_index("parent", ":", 1)
    rows = edges.where("child like 'setup:%'").groupBy("symbol", F.col("child").alias("setup"))
    return rows.agg(*(F.min(F.when(kind == k, F.col("parent"))).alias(k) for k in ("gap", "shift", "sweep")), F.count_if(kind == "level").alias("levels"))
