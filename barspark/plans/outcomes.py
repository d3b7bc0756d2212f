"""What became of orders: fills, results, exit models and their diagnostics.

An order is (id, symbol, decision, is_long, price, stop, target): from position
``decision`` on, the first bar whose range holds the price fills it.  Everything
later is a first passage of some level, found in one ordered pass over bars and
levels, or an extreme over the order's life, found in a join by position cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.firsthit import FAR, first_beyond, first_inside

#: Levels of an order by number: stop, target, and 1, 2 and 3 multiples of risk.
STOP, TARGET = 0, 9


def side() -> Column:
    return F.when(F.col("is_long"), 1.0).otherwise(-1.0)


def risk() -> Column:
    return F.abs(F.col("price") - F.col("stop"))


def _life(orders: DataFrame, bars: DataFrame, first: str, last: str, cell: int) -> DataFrame:
    """Orders beside the bars of their life [first, last], by cells of positions."""
    spread = orders.withColumn("cell_", F.explode(F.sequence(F.floor(F.col(first) / cell), F.floor(F.col(last) / cell))))
    keyed = bars.select("symbol", F.col("pos").alias("at"), "high", "low", "close", F.floor(F.col("pos") / cell).alias("cell_"))
    return spread.join(keyed, ["symbol", "cell_"]).where(F.col("at").between(F.col(first), F.col(last))).drop("cell_")


def fills(orders: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Orders with fill (null within ``horizon`` bars of the decision: none) and end, the last bar of their life."""
    out = first_inside(orders.withColumn("level", F.col("price")), bars, "decision").drop("level")
    out = out.withColumn("fill", F.when(F.col("hit_pos") <= F.col("decision") + horizon, F.col("hit_pos"))).drop("hit_pos")
    last = bars.groupBy("symbol").agg(F.max("pos").alias("last_pos"))
    return out.join(last, "symbol").withColumn("end", F.least(F.col("fill") + horizon, F.col("last_pos"))).drop("last_pos")


def passages(filled: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions at which filled orders first reach their stop, target and multiples of risk; null beyond their end."""
    level = lambda n, s, price: F.struct(F.lit(n).alias("what"), s.alias("side"), price.alias("level"))
    levels = [level(STOP, -side(), F.col("stop")), level(TARGET, side(), F.col("target"))] + [level(n, side(), F.col("price") + side() * n * risk()) for n in (1, 2, 3)]
    points = filled.where("fill is not null").select("symbol", "id", "end", (F.col("fill") - 1).alias("since"), F.explode(F.array(*levels)).alias("x"))
    hits = first_beyond(points.select("symbol", "id", "end", "since", "x.*"), bars, "since", strict=False).where("hit_pos <= end")
    at = lambda n, name: F.min(F.when(F.col("what") == n, F.col("hit_pos"))).alias(name)
    found = hits.groupBy("id").agg(at(STOP, "stop_pos"), at(TARGET, "target_pos"), *(at(n, f"r{n}_pos") for n in (1, 2, 3)))
    return filled.join(found, "id", "left")


def labels(orders: DataFrame, bars: DataFrame, horizon: int = 96) -> DataFrame:
    """Orders with what became of them.

    result: NO_FILL, TARGET, STOP, AMBIGUOUS (stop and target in one bar, no
    multiple of risk) or HORIZON (marked at the last close); realized, in
    multiples of risk; r1, r2, r3: yes, no or ambiguous before the stop;
    before_stop likewise for the target; mfe and mae over the life fill..final.
    Orders without risk have the result INVALID.
    """
    valid = passages(fills(orders.where(risk() > 0), bars, horizon), bars)
    s, t = F.coalesce("stop_pos", F.lit(FAR)), F.coalesce("target_pos", F.lit(FAR))
    result = F.when(F.col("fill").isNull(), "NO_FILL").when((s == FAR) & (t == FAR), "HORIZON").when(s == t, "AMBIGUOUS").when(t < s, "TARGET").otherwise("STOP")
    out = valid.withColumn("result", result).withColumn("final", F.when(F.col("fill").isNotNull(), F.least(s, t, F.col("end"))))
    reach = lambda c: F.when(F.col("fill").isNull(), None).when(F.col(c).isNull() | (s < F.col(c)), "no").when(s == F.col(c), "ambiguous").otherwise("yes")
    out = out.withColumns({"before_stop": reach("target_pos"), **{f"r{n}": reach(f"r{n}_pos") for n in (1, 2, 3)}})
    life = _life(out.where("fill is not null").select("id", "symbol", "fill", "final", "end", "is_long", "price"), bars, "fill", "end", horizon + 1)
    best = F.when(F.col("is_long"), F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low"))
    worst = F.when(F.col("is_long"), F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price"))
    lived = F.col("at") <= F.col("final")
    found = life.groupBy("id").agg(
        F.max(F.when(lived, best)).alias("mfe_"), F.max(F.when(lived, worst)).alias("mae_"), F.max_by("close", "at").alias("last_close"),
        F.max_by("at", F.when(lived, F.struct(best, -F.col("at")))).alias("mfe_pos"), F.max(best).alias("mfe_ever"),
    )
    out = out.join(found, "id", "left")
    mark = side() * (F.col("last_close") - F.col("price")) / risk()
    realized = F.when(F.col("result") == "TARGET", F.abs(F.col("target") - F.col("price")) / risk()).when(F.col("result") == "STOP", -1.0).when(F.col("result") == "HORIZON", mark)
    out = out.withColumns({"realized": F.round(realized, 3), "mark": F.round(mark, 3), "mfe": F.round(F.col("mfe_") / risk(), 3), "mae": F.round(F.col("mae_") / risk(), 3)})
    invalid = orders.where(risk() <= 0).withColumn("result", F.lit("INVALID"))
    return out.drop("mfe_", "mae_", "last_close").unionByName(invalid, allowMissingColumns=True)


def exit_models(labelled: DataFrame, bars: DataFrame) -> DataFrame:
    """Results of five exit rules for labelled orders: fixed_2, fixed_3, structural, breakeven, runner, each with ``_r``.

    breakeven: after one multiple of risk the stop moves to the price; runner:
    half is closed at two multiples, the rest goes on so.
    """
    filled = labelled.where("fill is not null")
    moves = [F.struct(F.lit(n).alias("what"), F.col(f"r{n}_pos").alias("since")) for n in (1, 2)]
    points = filled.select("symbol", "id", "end", (-side()).alias("side"), F.col("price").alias("level"), F.explode(F.array(*moves)).alias("x")).select("symbol", "id", "end", "side", "level", "x.*")
    back = first_beyond(points.where("since is not null"), bars, "since", strict=False).where("hit_pos <= end")
    back = back.groupBy("id").agg(*(F.min(F.when(F.col("what") == n, F.col("hit_pos"))).alias(f"back_{n}") for n in (1, 2)))
    out = labelled.join(back, "id", "left")
    far = lambda c: F.coalesce(F.col(c), F.lit(FAR))
    s, t = far("stop_pos"), far("target_pos")
    reward, mark = F.round(F.abs(F.col("target") - F.col("price")) / risk(), 3), F.col("mark")
    none = F.col("fill").isNull()

    def rule(cases: list[tuple[Column, str, Column]]) -> tuple[Column, Column]:
        name, value = F.when(none, "NO_FILL"), F.when(none, F.lit(None).cast("double"))
        for condition, word, r in cases:
            name, value = name.when(condition, word), value.when(condition, r)
        return name, F.round(value, 3)

    null, minus = F.lit(None).cast("double"), F.lit(-1.0)
    rules = {}
    for n in (2, 3):
        h = far(f"r{n}_pos")
        rules[f"fixed_{n}"] = rule([((h == FAR) & (s == FAR), "HORIZON", mark), (h == s, "AMBIGUOUS", null), (h < s, "TARGET", F.lit(float(n))), (s < h, "STOP", minus)])
    aimless = F.col("target").isNull()
    rules["structural"] = rule([(aimless, "NO_TARGET", null), ((t == FAR) & (s == FAR), "HORIZON", mark), (t == s, "AMBIGUOUS", null), (t < s, "TARGET", reward), (s < t, "STOP", minus)])
    for name, n, gain in (("breakeven", 1, 0.0), ("runner", 2, 1.0)):
        h, b = far(f"r{n}_pos"), far(f"back_{n}")
        first = F.least(s, h, t)
        after = "PARTIAL+" if gain else ""
        share = 1 - gain / 2
        rules[name] = rule([
            (aimless, "NO_TARGET", null), (first == FAR, "HORIZON", mark), ((s == first) & ((h == first) | (t == first)), "AMBIGUOUS", null), (t == first, "TARGET", reward), (s == first, "STOP", minus),
            ((b == FAR) & (t == FAR), f"{after}HORIZON", gain + share * mark), (b == t, "AMBIGUOUS", null), (t < b, f"{after}TARGET", gain + share * reward), (b < t, f"{after}BE", F.lit(gain)),
        ])
    return out.select(*labelled.columns, *(c.alias(n) for k, (a, b) in rules.items() for n, c in ((k, a), (f"{k}_r", b))))


def stop_quality(labelled: DataFrame, bars: DataFrame, horizon: int = 96, short: int = 12, recover: float = 2.0) -> DataFrame:
    """For filled orders: whether the stop was reached, how far they went before and after it, and a bucket.

    premature_stop: ``recover`` multiples of risk in favour within ``short`` bars after
    the stop; late_continuation: later; true_invalidation: never; survived: no stop.
    """
    filled = labelled.where("fill is not null").select("id", "symbol", "is_long", "price", "stop", "target", "fill", "end", "stop_pos")
    back = filled.where("stop_pos is not null").select("symbol", "id", "end", F.col("stop_pos").alias("since"), side().alias("side"), (F.col("price") + side() * recover * risk()).alias("level"))
    back = first_beyond(back, bars, "since", strict=False).where("hit_pos <= end").select("id", F.col("hit_pos").alias("recovery_pos"))
    best = F.when(F.col("is_long"), F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low"))
    until, after = F.col("at") <= F.coalesce("stop_pos", "end"), F.col("at") > F.col("stop_pos")
    gone = _life(filled, bars, "fill", "end", horizon + 1).groupBy("id").agg(F.max(F.when(until, best)).alias("before_"), F.max(F.when(after, best)).alias("after_"))
    out = filled.join(gone, "id").join(back, "id", "left")
    wait = F.col("recovery_pos") - F.col("stop_pos")
    bucket = F.when(F.col("stop_pos").isNull(), "survived").when(wait <= short, "premature_stop").when(wait.isNotNull(), "late_continuation").otherwise("true_invalidation")
    over = lambda c: F.round(F.greatest(F.lit(0.0), F.col(c) / risk()), 3)
    return out.select("id", "symbol", bucket.alias("bucket"), (F.col("stop_pos") - F.col("fill")).alias("bars_to_stop"), over("before_").alias("mfe_before_stop"), F.when(F.col("stop_pos").isNotNull(), F.coalesce(over("after_"), F.lit(0.0))).alias("mfe_after_stop"), wait.alias("bars_to_recovery"))


def near_misses(labelled: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """How much of the way to its target a stopped order's price went in the ``horizon`` bars after the stop."""
    stopped = labelled.where("result = 'STOP' and target is not null").select("id", "symbol", "is_long", "price", "target", (F.col("final") + 1).alias("from_"), (F.col("final") + horizon).alias("to_"))
    best = F.when(F.col("is_long"), F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low"))
    share = F.greatest(F.lit(0.0), best) / F.abs(F.col("target") - F.col("price"))
    found = _life(stopped, bars, "from_", "to_", horizon + 1).groupBy("id").agg(F.max(share).alias("share"))
    out = stopped.select("id").join(found, "id", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return out.select("id", *((F.col("share") >= x).alias(n) for n, x in (("half", 0.5), ("three_quarters", 0.75), ("whole", 1.0))), F.round("share", 6).alias("share"))
