"""Market-structure detectors over bars with positions: pools, sweeps, shifts, gaps, rolls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.session import active_sessions, eastern, third_friday
from barspark.operators import windows as V
from barspark.operators.bars import session_bars
from barspark.operators.firsthit import first_beyond
from barspark.operators.joins import as_of
from barspark.sources.shared import written


def pivots(bars: DataFrame, width: int = 2) -> DataFrame:
    """One row per fractal pivot: symbol, pos, ts, kind (1 high, -1 low), price, confirm_pos."""
    marked = bars.withColumn("h_", V.fractal("high", True, width)).withColumn("l_", V.fractal("low", False, width))
    both = F.array(F.when(F.col("h_"), F.struct(F.lit(1).alias("kind"), F.col("high").alias("price"))), F.when(F.col("l_"), F.struct(F.lit(-1).alias("kind"), F.col("low").alias("price"))))
    rows = marked.select("symbol", "pos", "ts", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("p"))
    return rows.select("symbol", "pos", "ts", "p.kind", "p.price", (F.col("pos") + width).alias("confirm_pos"))


def skeleton(found: DataFrame) -> DataFrame:
    """Runs of pivots of one side collapse into their extreme, the first of equal ones; ``dominant``: beyond both neighbours of its kind."""
    order = Window.partitionBy("symbol").orderBy("pos", "kind")
    marked = found.withColumn("run", F.sum((F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit(0))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct(F.col("kind") * F.col("price"), -F.col("pos"))
    legs = marked.groupBy("symbol", "run", "kind").agg(F.max_by("pos", first).alias("pos"), F.max_by("price", first).alias("price"))
    same = Window.partitionBy("symbol", "kind").orderBy("pos")
    beyond = lambda other: F.coalesce(F.col("kind") * F.col("price") > F.col("kind") * other, F.lit(True))
    return legs.withColumn("dominant", beyond(F.lag("price").over(same)) & beyond(F.lead("price").over(same)))


def pools(found: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar after a pivot's confirmation whose wick passes its level; ``swept`` if it closed back."""
    points = found.withColumn("side", F.col("kind")).withColumn("level", F.col("price"))
    out = first_beyond(points, bars, "confirm_pos", carry=("close", "high", "low")).drop("side", "level")
    out = out.withColumn("extreme", F.when(F.col("kind") == 1, F.col("hit_high")).otherwise(F.col("hit_low"))).drop("hit_high", "hit_low")
    return out.withColumn("swept", F.coalesce(F.when(F.col("kind") == 1, F.col("hit_close") < F.col("price")).otherwise(F.col("hit_close") > F.col("price")), F.lit(False)))


def displacements(sweeps: DataFrame, minor: DataFrame) -> DataFrame:
    """From a sweep to the first later confirmed pivot on the opposite side: net move and bars."""
    opposite = minor.select("symbol", (-F.col("kind")).alias("kind"), F.col("pos").alias("end_pos"), F.col("price").alias("end_price"))
    after = sweeps.where("swept").withColumn("from_pos", F.col("hit_pos") + 1)
    met = as_of(after, opposite, ["symbol", "kind"], "from_pos", "end_pos", ["end_pos", "end_price"], forward=True)
    return met.where("end_pos is not null").withColumn("net_move", F.abs(F.col("end_price") - F.col("extreme"))).withColumn("bars", F.col("end_pos") - F.col("hit_pos")).drop("from_pos")


def shifts(sweeps: DataFrame, found: DataFrame, bars: DataFrame) -> DataFrame:
    """First close, after a sweep, beyond the last opposite pivot that was there before it; null while there is none."""
    opposite = found.select("symbol", (-F.col("kind")).alias("kind"), F.col("pos").alias("ref_pos"), F.col("price").alias("ref_price"))
    before = as_of(sweeps.where("swept").withColumn("before_pos", F.col("hit_pos") - 1), opposite, ["symbol", "kind"], "before_pos", "ref_pos", ["ref_pos", "ref_price"]).where("ref_pos is not null").drop("before_pos")
    points = before.withColumnRenamed("hit_pos", "sweep_pos").withColumn("side", -F.col("kind")).withColumn("level", F.col("ref_price"))
    out = first_beyond(points, bars, "sweep_pos", up="close", down="close")
    return out.withColumnRenamed("hit_pos", "mss_pos").withColumnRenamed("sweep_pos", "hit_pos").drop("side", "level")


def gap_shapes(bars: DataFrame) -> DataFrame:
    """Three-bar gaps at their third bar: symbol, pos, ts, way, bottom, top and start_ts, the first bar's time."""
    w = Window.partitionBy("symbol").orderBy("pos")
    marked = bars.withColumn("h0", F.lag("high", 2).over(w)).withColumn("l0", F.lag("low", 2).over(w)).withColumn("start_ts", F.lag("ts", 2).over(w))
    up, down = F.col("low") > F.col("h0"), F.col("high") < F.col("l0")
    bottom, top = F.when(up, F.col("h0")).otherwise(F.col("high")), F.when(up, F.col("low")).otherwise(F.col("l0"))
    return marked.where(up | down).select("symbol", "pos", "ts", F.when(up, 1).otherwise(-1).alias("way"), bottom.alias("bottom"), top.alias("top"), "start_ts")


def gaps(bars: DataFrame) -> DataFrame:
    """Three-bar gaps, with the first later bars that touch and that fill them."""
    found = gap_shapes(bars).drop("start_ts")
    near = F.when(F.col("way") == 1, F.col("top")).otherwise(F.col("bottom"))
    far = F.when(F.col("way") == 1, F.col("bottom")).otherwise(F.col("top"))
    points = found.withColumn("x", F.explode(F.array(F.struct(F.lit("touch").alias("what"), near.alias("level")), F.struct(F.lit("fill").alias("what"), far.alias("level")))))
    points = points.select(*found.columns, (-F.col("way")).alias("side"), "x.what", "x.level")
    met = first_beyond(points, bars, "pos", strict=False)
    first = lambda what: F.min(F.when(F.col("what") == what, F.col("hit_pos"))).alias(f"{what}_pos")
    return met.groupBy("symbol", "pos", "ts", F.col("way").alias("side"), "bottom", "top").agg(first("touch"), first("fill"))


def dealing_range(legs: DataFrame) -> DataFrame:
    """Last structural high and low of each symbol, with their middle."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("price")), F.when(F.col("kind") == kind, F.col("pos")))
    out = legs.groupBy("symbol").agg(last(1).alias("range_high"), last(-1).alias("range_low"))
    return out.withColumn("equilibrium", (F.col("range_high") + F.col("range_low")) / 2)


def ranked(items: DataFrame, by: list[str], factors: list[str], position: str) -> DataFrame:
    """Lexicographic rank, larger factors first, input order on ties; ``tied`` where all factors equal another row's."""
    order = Window.partitionBy(*by).orderBy(*(F.col(c).desc_nulls_last() for c in factors), position)
    return items.withColumn("rank", F.row_number().over(order)).withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy(*by, *factors)) > 1)


def rolls(daily: DataFrame) -> DataFrame:
    """Contract rolls: the largest opening gap within five days of eight days before a quarter's third Friday."""
    before = daily.withColumn("gap", F.abs(F.col("open") - F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))))
    quarter = F.date_add(F.add_months(F.date_trunc("quarter", "day"), 2).cast("date"), 0)
    nominal = F.date_sub(third_friday(quarter), 8)
    near = before.withColumn("nominal", nominal).where("gap is not null and abs(datediff(day, nominal)) <= 5")
    return near.groupBy("symbol", "nominal").agg(F.max_by("day", F.struct(F.col("gap"), -F.unix_date("day"))).alias("day"), F.max("gap").alias("gap"))


def segments(daily: DataFrame, found: DataFrame) -> DataFrame:
    """Number of the contract segment that each day belongs to."""
    marked = daily.join(found.select("symbol", "day", F.lit(1).alias("roll")), ["symbol", "day"], "left")
    line = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("segment", F.coalesce(F.sum("roll").over(line), F.lit(0)))


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from ``start(root, node)`` over ``edges(child, parent)``, with the fewest steps to each.

    A step joins only the nodes that the last one found and goes on until there are
    no new ones, so cycles end too; each step is written and cuts the lineage.
    """
    edges = written(edges.select("child", "parent").where("child is not null and parent is not null").distinct(), "edges")
    found = frontier = written(start.select("root", "node").distinct().withColumn("depth", F.lit(0)), "reached")
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("child")).select("root", F.col("parent").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = written(step.join(found.select("root", "node"), ["root", "node"], "left_anti"), "reached")
        found = written(found.unionByName(frontier), "reached")
    return found


def impulse_legs(bars: DataFrame) -> DataFrame:
    """Bars with swing flags and the last confirmed leg of each direction known at them.

    Up: the last confirmed swing low and the last of the three newest swing highs
    that came after it; down: the mirror.  Null where no swing followed.
    """
    frame = bars.withColumn("hs_", V.last_pivots("sh", "high", 2, 3)).withColumn("ls_", V.last_pivots("sl", "low", 2, 3))
    last = lambda c: F.element_at(c, -1)
    after = lambda c, base: F.filter(c, lambda x: x["pos"] > last(base)["pos"])
    up, down = after("hs_", "ls_"), after("ls_", "hs_")
    out = frame.withColumn("up_end", F.try_element_at(up, F.lit(-1))["high"]).withColumn("down_end", F.try_element_at(down, F.lit(-1))["low"])
    out = out.withColumn("up_start", F.when(F.col("up_end").isNotNull(), last("ls_")["low"])).withColumn("down_start", F.when(F.col("down_end").isNotNull(), last("hs_")["high"]))
    return out.drop("hs_", "ls_")


def bias(slope: int) -> Column:
    """bullish or bearish where averages (fast, mid, slow), the slow one's slope and the last two swings agree."""
    highs, lows = V.last_pivots("sh", "high", 2, 2), V.last_pivots("sl", "low", 2, 2)
    h, l = (lambda i: highs[i]["high"]), (lambda i: lows[i]["low"])  # noqa: E741
    before = F.lag("slow", slope).over(V.in_time())
    up = (F.col("close") > F.col("slow")) & (F.col("fast") > F.col("mid")) & (F.col("mid") > F.col("slow")) & (F.col("slow") > before) & (h(1) > h(0)) & (l(1) > l(0))
    down = (F.col("close") < F.col("slow")) & (F.col("fast") < F.col("mid")) & (F.col("mid") < F.col("slow")) & (F.col("slow") < before) & (h(1) < h(0)) & (l(1) < l(0))
    return F.when(up, "bullish").when(down, "bearish").otherwise("neutral")


def liquidity_registry(bars: DataFrame) -> DataFrame:
    """High and low of the last finished day and week and of each named session's last finished instance.

    name is PD, PW or the session's; an instance is finished when a bar outside
    it has come.  Bars may be of any length up to an hour.
    """
    named = {"asia": "ASIA", "london_active": "LONDON", "ny_am": "NY_AM", "ny_pm": "NY_PM"}
    out = None
    for name, weekly in (("PD", False), ("PW", True)):
        periods = session_bars(bars, weekly).withColumn("at_", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("session").desc()))).where("at_ = 2")
        part = periods.select("symbol", F.lit(name).alias("name"), F.col("session").alias("period"), "high", "low")
        out = part if out is None else out.unionByName(part)
    local = eastern(F.col("ts"))
    last = bars.withColumn("last_", F.max("ts").over(Window.partitionBy("symbol")))
    inside = last.withColumn("name", F.explode(active_sessions(F.col("ts")))).groupBy("symbol", "name", F.to_date(local).alias("period"))
    inside = inside.agg(F.max("high").alias("high"), F.min("low").alias("low"), (F.max("ts") == F.first("last_")).alias("running")).where("not running")
    newest = inside.withColumn("at_", F.row_number().over(Window.partitionBy("symbol", "name").orderBy(F.col("period").desc()))).where("at_ = 1")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), F.col("name"))
    return out.unionByName(newest.select("symbol", label.alias("name"), "period", "high", "low"))


def roll_metadata(segmented: DataFrame) -> DataFrame:
    """Days since the segment's roll and, looking ahead, until its end."""
    line = Window.partitionBy("symbol", "segment").orderBy("day")
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol", "segment"))
    at = F.row_number().over(line)
    return segmented.withColumn("since_roll", (at - 1).cast("long")).withColumn("until_roll", (size - at).cast("long"))
