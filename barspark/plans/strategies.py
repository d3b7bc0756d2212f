"""Strategy rules as columns: each adds or returns ``direction`` (1 long, -1 short, null none)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.session import eastern, in_window, minute_of_day
from barspark.operators.windows import in_time, change_rate


def liquidity_sweep(bars: DataFrame) -> DataFrame:
    """A wick through the confirmed swing (``ch``, ``cl``) that closes back inside."""
    short = (F.col("high") > F.col("ch")) & (F.col("close") < F.col("ch"))
    long = (F.col("low") < F.col("cl")) & (F.col("close") > F.col("cl"))
    return bars.withColumn("direction", F.when(short, -1).when(long, 1))


def _local(bars: DataFrame) -> DataFrame:
    return bars.withColumn("et_", eastern(F.col("ts"))).withColumn("day", F.to_date("et_")).withColumn("minute", minute_of_day(F.col("et_"))).drop("et_")


def opening_gap(bars: DataFrame, least: float) -> DataFrame:
    """First bar from 09:30 that opens at least ``least`` ATR from the previous calendar day's last close before 16:00."""
    local = _local(bars)
    prior = local.where("minute < 960").groupBy("symbol", F.date_add("day", 1).alias("day")).agg(F.max_by("close", "ts").alias("prior"))
    first = local.where("minute >= 570").withColumn("at", F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts"))).where("at = 1")
    gap = F.col("open") - F.col("prior")
    return first.join(prior, ["symbol", "day"]).where((F.abs(gap) >= least * F.col("atr")) & (F.col("atr") > 0)).withColumn("direction", F.when(gap > 0, 1).otherwise(-1))


def opening_range_breakout(bars: DataFrame, opening: tuple[int, int], cutoff: int) -> DataFrame:
    """First break of the opening range before the cutoff, upwards first; stop at the other extreme."""
    local = _local(bars)
    ranges = local.where(in_window(F.col("minute"), *opening)).groupBy("symbol", "day").agg(F.max("high").alias("oh"), F.min("low").alias("ol"))
    later = local.where(in_window(F.col("minute"), opening[1], cutoff)).join(ranges, ["symbol", "day"]).where("high > oh or low < ol")
    first = later.withColumn("at", F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts"))).where("at = 1")
    up = F.col("high") > F.col("oh")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return first.withColumn("direction", F.when(up, 1).otherwise(-1)).withColumn("entry", pick("oh", "ol")).withColumn("stop", pick("ol", "oh"))


def pullback(bars: DataFrame, least: float, n: int) -> DataFrame:
    """Close back across the fast average in the direction of the slow one's slope."""
    before = F.lag("close").over(in_time())
    frame = bars.withColumn("slope", change_rate("slow", n)).withColumn("before", before).where(F.col("fast").isNotNull() & (F.abs("slope") >= least))
    up = F.col("slope") > 0
    resumed = F.when(up, (F.col("before") <= F.col("fast")) & (F.col("close") > F.col("fast"))).otherwise((F.col("before") >= F.col("fast")) & (F.col("close") < F.col("fast")))
    return frame.where(resumed).withColumn("direction", F.when(up, 1).otherwise(-1))


def horizon_policies(frame: DataFrame, horizons: list[str], least: float, hurdle: float) -> DataFrame:
    """Four ways to combine per-horizon directions ``d*`` with confidences ``c*``."""
    d, c = [F.col(f"d{h}") for h in horizons], [F.col(f"c{h}") for h in horizons]
    same = reduce(lambda a, b: a & b, [x == d[0] for x in d[1:]])
    total = reduce(lambda a, b: a + b, [x * y for x, y in zip(c, d)])
    best = F.greatest(*c)
    sure = F.coalesce(*(F.when(x == best, y) for x, y in zip(c, d)))
    return frame.withColumns({"agreement": F.when(same & (F.least(*c) >= least), d[0]), "weighted": F.when(F.abs(total) >= hurdle, F.signum(total)), "most_sure": sure, "longest": d[-1]})


def window_max(signals: DataFrame, n: int) -> DataFrame:
    """Strongest signal of each run of n positions, decided at its end; the first of equal ones."""
    bucket = F.floor(F.col("pos") / n)
    out = signals.groupBy("symbol", bucket.alias("bucket")).agg(F.max_by("direction", F.struct("strength", -F.col("pos"))).alias("direction"))
    return out.withColumn("decided_pos", F.col("bucket") * n + n - 1)


def crossings(frame: DataFrame, keep: bool = False) -> DataFrame:
    """Rows where ``fast`` crosses ``slow``; ``keep``: all rows, with direction 0 elsewhere."""
    sign = F.signum(F.col("fast") - F.col("slow"))
    before = F.coalesce(F.lag("s_").over(in_time()), F.lit(0.0))
    marked = frame.withColumn("s_", sign).withColumn("b_", before)
    marked = marked.withColumn("direction", F.when((F.col("s_") > 0) & (F.col("b_") <= 0), 1).when((F.col("s_") < 0) & (F.col("b_") >= 0), -1).otherwise(0)).drop("s_", "b_")
    return marked if keep else marked.where("direction <> 0")


def overnight_imbalance(bars: DataFrame, close: int = 960, open_: int = 570) -> DataFrame:
    """Signed volume from a day's close to the next morning's opening, keyed by that morning."""
    local = _local(bars).where(f"minute >= {close} or minute < {open_}")
    day = F.when(F.col("minute") >= close, F.date_add("day", 1)).otherwise(F.col("day"))
    return local.groupBy("symbol", day.alias("day")).agg(F.sum(F.col("volume") * F.signum(F.col("close") - F.col("open"))).alias("imbalance"))


def overnight(bars: DataFrame, least: float, days: int, open_: int = 570) -> DataFrame:
    """First bar after the opening, in the direction of an imbalance that ranks ``least`` or more among its last ``days``."""
    size = F.abs("imbalance")
    values = F.collect_list(size).over(Window.partitionBy("symbol").orderBy("day").rowsBetween(1 - days, 0))
    rank = F.aggregate("values_", F.lit(0.0), lambda a, v: a + F.when(v < size, 1.0).when(v == size, 0.5).otherwise(0.0)) + 0.5
    rated = overnight_imbalance(bars).withColumn("values_", values).withColumn("p_", F.when(F.size("values_") == days, rank / days)).where((F.col("p_") >= least) & (F.col("imbalance") != 0))
    first = first_of_day(bars, open_)
    return first.join(rated, ["symbol", "day"]).withColumn("direction", F.signum("imbalance").cast("int")).drop("values_", "p_")


def first_of_day(bars: DataFrame, minute: int) -> DataFrame:
    later = _local(bars).where(F.col("minute") >= minute)
    return later.withColumn("at_", F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts"))).where("at_ = 1").drop("at_")


def seeded_direction(rows: DataFrame, seed: int) -> DataFrame:
    """A direction that only the day, the symbol and the seed decide."""
    return rows.withColumn("direction", F.when(F.pmod(F.xxhash64("symbol", "day", F.lit(seed)), F.lit(2)) == 0, 1).otherwise(-1))


def vwap_reclaim(bars: DataFrame, far: float = 1.0, near: float = 0.15) -> DataFrame:
    """A touch of the session's mean price after a stretch away from it, in the direction of that stretch.

    Bars either touch (within ``near`` ATR), stretch (beyond ``far`` ATR) or say
    nothing; a touch whose last word before was a stretch is a signal.
    """
    dist = F.col("close") - F.col("vwap")
    mark = F.when(F.abs(dist) <= near * F.col("atr"), 0).when(dist > far * F.col("atr"), 1).when(dist < -far * F.col("atr"), -1)
    said = bars.where("atr > 0 and vwap is not null").withColumn("mark_", mark).where("mark_ is not null")
    return said.withColumn("direction", F.lag("mark_").over(in_time())).where("mark_ = 0 and direction <> 0").drop("mark_")


def stop_target(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """Entries (id, symbol, pos, is_long, price, stop, target): reason (stop before target, target, open) and bars to it."""
    from barspark.operators.firsthit import FAR, first_beyond

    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    levels = F.array(F.struct(F.lit("stop").alias("what"), (-side).alias("side"), F.col("stop").alias("level")), F.struct(F.lit("target").alias("what"), side.alias("side"), F.col("target").alias("level")))
    hits = first_beyond(entries.select("symbol", "id", "pos", F.explode(levels).alias("x")).select("symbol", "id", "pos", "x.*"), bars, "pos", strict=False)
    at = lambda w: F.coalesce(F.min(F.when(F.col("what") == w, F.col("hit_pos") - F.col("pos"))), F.lit(FAR)).alias(f"{w}_at")
    out = hits.groupBy("id").agg(at("stop"), at("target"))
    first = F.least("stop_at", "target_at")
    return out.withColumn("bars", F.when(first < FAR, first)).withColumn("reason", F.when(first == FAR, "open").when(F.col("stop_at") <= F.col("target_at"), "stop").otherwise("target"))


def session_flags(bars: DataFrame, windows: list[tuple[int, int]], minutes: int) -> DataFrame:
    """ending: the bar's close reaches the last window's end, or no later bar of its day follows; allowed; off_hours (by the clock alone)."""
    from barspark.functions.session import within_any

    local = _local(bars)
    late = F.col("minute") + minutes >= windows[-1][1]
    following = F.lead("day").over(in_time())
    allowed = within_any(F.col("minute"), windows)
    return local.withColumn("ending", late | following.isNull() | (following != F.col("day"))).withColumn("allowed", allowed).withColumn("off_hours", ~(allowed & ~late))


def fib_pullback(frame: DataFrame) -> DataFrame:
    """Rising bars that close in the golden zone of the leg a to b; ``confluence``: near the average ``e21`` too."""
    from barspark.functions.scalars import between_levels, fib_level, has_confluence

    a, b = F.col("a"), F.col("b")
    golden = between_levels(F.col("close"), fib_level(a, b, 0.618), fib_level(a, b, 0.5))
    rows = frame.where("atr > 0 and e21 is not null and a < b and close > open").where(golden)
    return rows.withColumn("confluence", has_confluence(F.col("close"), F.col("e21"), F.col("atr")))


def reversal(frame: DataFrame, slack: float = 0.25) -> DataFrame:
    """Engulfing bars at the edge of the leg a to b, within ``slack`` ATR."""
    from barspark.functions.scalars import engulfs_down, engulfs_up

    marked = frame.withColumn("o1_", F.lag("open").over(in_time())).withColumn("c1_", F.lag("close").over(in_time()))
    up = (F.col("low") <= F.col("a") + slack * F.col("atr")) & engulfs_up(F.col("o1_"), F.col("c1_"))
    down = (F.col("high") >= F.col("b") - slack * F.col("atr")) & engulfs_down(F.col("o1_"), F.col("c1_"))
    return marked.where("atr > 0").withColumn("direction", F.when(up, 1).when(down, -1)).where("direction is not null").drop("o1_", "c1_")


def over_hurdle(frame: DataFrame, hurdle: float) -> DataFrame:
    """Direction of an expected value beyond the hurdle, else 0; null where it is unknown."""
    ev = F.col("ev")
    return frame.withColumn("direction", F.when(ev > hurdle, 1).when(ev < -hurdle, -1).when(ev.isNotNull(), 0))


def scene_scores(bars: DataFrame) -> DataFrame:
    """How much a bar could teach (value), how executable it looks (selectivity), and whether it is trivial."""
    frame = bars.withColumn("body_", F.abs(F.col("close") - F.col("open")) / F.col("atr")).withColumn("span_", (F.col("high") - F.col("low")) / F.col("atr")).withColumn("busy_", F.least(F.col("volume") / 10, F.lit(1.0)))
    value = 0.5 * F.least("body_", F.lit(2.0)) / 2 + 0.3 * F.least("span_", F.lit(3.0)) / 3 + 0.2 * F.col("busy_")
    selective = 0.7 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("body_") - 1)) + 0.3 * F.col("busy_")
    out = frame.withColumn("value", F.round(value, 9)).withColumn("selectivity", F.round(selective, 9)).withColumn("trivial", (F.col("body_") < 0.1) & (F.col("span_") < 0.5))
    return out.drop("body_", "span_", "busy_")
