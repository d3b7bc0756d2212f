"""Marks against the chain, and models of picks and outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import placed, r6, swings, with_atr
from barspark.catalog.models import logs
from barspark.catalog.outcomes import HORIZON
from barspark.catalog.setups import _CHAIN
from barspark.functions import scalars as C
from barspark.functions.session import eastern
from barspark.operators import structure as D
from barspark.operators import windows as V
from barspark.operators.windows import in_time
from barspark.plans import bundles as B
from barspark.plans import features as X
from barspark.plans import logistic as L
from barspark.plans import outcomes as O
from barspark.plans import research as R
from barspark.plans import setups as P
from barspark.sources import stores
from barspark.sources.shared import shared_dir, written

_COMPARED = f"""{_CHAIN}, dy AS (SELECT symbol, pos, et::DATE AS day FROM x),
cd AS (SELECT q.symbol, dy.day, 'manipulation' AS dimension, -q.kind AS way, q.price, row_number() OVER (PARTITION BY q.symbol, dy.day ORDER BY abs(extreme - price) DESC, q.pos DESC, q.kind) AS rank FROM pool q JOIN dy ON dy.symbol = q.symbol AND dy.pos = q.hit_pos WHERE swept
  UNION ALL SELECT m.symbol, dy.day, 'shift', way, broken_price, row_number() OVER (PARTITION BY m.symbol, dy.day ORDER BY CASE state WHEN 'confirmed' THEN 2 WHEN 'candidate' THEN 1 ELSE 0 END DESC, acceptance DESC, broken_pos DESC, level_pos DESC, way) FROM ms m JOIN dy ON dy.symbol = m.symbol AND dy.pos = m.sweep_pos
  UNION ALL SELECT f.symbol, dy.day, 'gap', way, middle, row_number() OVER (PARTITION BY f.symbol, dy.day ORDER BY CASE status WHEN 'unfilled' THEN 2 WHEN 'touched' THEN 1 ELSE 0 END DESC, formed_pos DESC, way) FROM fv f JOIN dy ON dy.symbol = f.symbol AND dy.pos = f.formed_pos),
dm0 AS (SELECT symbol, et::DATE AS day, arg_min(open, pos) AS o, arg_max(close, pos) AS c, max(high) AS h, min(low) AS l FROM x GROUP BY symbol, et::DATE),
dm AS (SELECT *, CASE WHEN c > o THEN 'LONG' WHEN c < o THEN 'SHORT' ELSE 'NO_TRADE' END AS decision, CASE WHEN c > o THEN 1 WHEN c < o THEN -1 END AS mw, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM dm0 WINDOW w AS (PARTITION BY symbol ORDER BY day)),
mk AS (SELECT symbol, day, 'manipulation' AS dimension, CASE mw WHEN 1 THEN l WHEN -1 THEN h END AS level, mw FROM dm UNION ALL SELECT symbol, day, 'shift', CASE mw WHEN 1 THEN ph WHEN -1 THEN pl END, NULL FROM dm UNION ALL SELECT symbol, day, 'gap', (h + l) / 2, NULL FROM dm),
mt AS (SELECT k.symbol, k.day, k.dimension, level, mw, count(rank) AS n_candidates, arg_min(way, rank) AS tw, min({{'off': abs(price - level), 'rank': rank}}) FILTER (WHERE rank IS NOT NULL AND (mw IS NULL OR way = mw)) AS best FROM mk k LEFT JOIN cd USING (symbol, day, dimension) WHERE level IS NOT NULL GROUP BY ALL),
mr0 AS (SELECT *, CASE WHEN best.off <= greatest(abs(level) * 0.0025, 1e-9) THEN best.rank END AS engine_rank FROM mt),
en AS (SELECT s.symbol, dy.day, count(*) AS n_setups, first(way ORDER BY rr DESC, round(risk, 2), formed_pos, way) FILTER (WHERE reject = '') AS way FROM st s JOIN dy ON dy.symbol = s.symbol AND dy.pos = s.formed_pos GROUP BY ALL),
rg AS (SELECT symbol, count(*) FILTER (WHERE kind = 1) > 0 AND count(*) FILTER (WHERE kind = -1) > 0 AS has_range FROM sk GROUP BY symbol),
dr0 AS (SELECT dm.symbol, dm.day, decision, n_setups, CASE way WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' ELSE 'NO-TRADE' END AS ed, coalesce(has_range, false) AS has_range FROM dm LEFT JOIN en USING (symbol, day) LEFT JOIN rg ON rg.symbol = dm.symbol),
cp AS (SELECT symbol, day, dimension, coalesce(engine_rank = 1, false) AS agree, engine_rank, n_candidates, CASE WHEN engine_rank = 1 THEN NULL WHEN engine_rank IS NULL THEN 'detector' WHEN tw <> mw THEN 'context' ELSE 'ranking' END AS category FROM mr0
  UNION ALL SELECT symbol, day, 'direction', decision = replace(ed, '-', '_'), NULL, NULL, CASE WHEN decision = replace(ed, '-', '_') THEN NULL WHEN ed <> 'NO-TRADE' AND decision <> 'NO_TRADE' THEN 'context' WHEN ed = 'NO-TRADE' AND n_setups > 0 THEN 'mechanization' WHEN ed = 'NO-TRADE' THEN 'detector' ELSE 'ambiguity' END FROM dr0
  UNION ALL SELECT symbol, day, 'dealing_range', CASE WHEN has_range THEN true END, NULL, NULL, CASE WHEN NOT has_range THEN 'context' END FROM dr0)"""


def marked(spark, d):
    """Scenes are New York days: what the chain found in each against marks with hindsight, the day's way, extremes, middle and yesterday's extremes."""
    bars = written(placed(spark, d), "bars").withColumn("day", F.to_date(eastern(F.col("ts"))))
    days = bars.select("symbol", F.col("pos").cast("long").alias("at_"), "day")
    of_day = lambda frame, pos: frame.withColumn("at_", F.col(pos).cast("long")).join(days, ["symbol", "at_"])
    scene = ["symbol", "day"]

    def ranked(frame, dimension, way, price, *order):
        place = F.row_number().over(Window.partitionBy(*scene).orderBy(*order))
        return frame.select(*scene, F.lit(dimension).alias("dimension"), way.cast("int").alias("way"), F.col(price).alias("price"), place.alias("rank"))

    pivots = D.pivots(bars)
    pools = of_day(D.pools(pivots, bars).where("swept"), "hit_pos")
    shifts = written(P.shifts(bars), "shifts")
    setups = written(P.setups(bars), "setups")
    level = lambda c, best, middle: F.when(F.col(c) == best, 2).when(F.col(c) == middle, 1).otherwise(0).desc()
    candidates = (
        ranked(pools, "manipulation", -F.col("kind"), "price", F.abs(F.col("extreme") - F.col("price")).desc(), F.desc("pos"), "kind")
        .unionByName(ranked(of_day(shifts, "sweep_pos"), "shift", F.col("way"), "broken_price", level("state", "confirmed", "candidate"), F.desc("acceptance"), F.desc("broken_pos"), F.desc("level_pos"), "way"))
        .unionByName(ranked(of_day(setups, "formed_pos"), "gap", F.col("way"), "middle", level("status", "unfilled", "touched"), F.desc("formed_pos"), "way"))
    )
    daily = bars.groupBy(*scene).agg(F.min_by("open", "pos").alias("o"), F.max_by("close", "pos").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"))
    way = F.when(F.col("c") > F.col("o"), 1).when(F.col("c") < F.col("o"), -1)
    yesterday = Window.partitionBy("symbol").orderBy("day")
    by_way = lambda up, down: F.when(way == 1, up).when(way == -1, down)
    marks = daily.select(
        *scene, F.coalesce(by_way(F.lit("LONG"), F.lit("SHORT")), F.lit("NO_TRADE")).alias("decision"), way.alias("manipulation_way"), by_way(F.col("l"), F.col("h")).alias("manipulation"),
        by_way(F.lag("h").over(yesterday), F.lag("l").over(yesterday)).alias("shift"), ((F.col("h") + F.col("l")) / 2).alias("gap"), F.when(F.col("c") < (F.col("h") + F.col("l")) / 2, "discount").otherwise("premium").alias("zone"),
    )
    best = F.when(F.col("actionable"), F.struct(-F.col("rr"), F.round("risk", 2), "formed_pos", "way"))
    taken = of_day(setups, "formed_pos").groupBy(*scene).agg(F.count("*").alias("n_setups"), F.min_by("way", best).alias("way"))
    legs = D.skeleton(pivots).groupBy("symbol").agg((F.bool_or(F.col("kind") == 1) & F.bool_or(F.col("kind") == -1)).alias("has_range"))
    engine = daily.select(*scene).join(taken, scene, "left").join(legs, "symbol", "left").withColumn("engine_decision", F.when(F.col("way") == 1, "LONG").when(F.col("way") == -1, "SHORT").otherwise("NO-TRADE")).drop("way")
    return R.compared(candidates, marks, engine, scene)


@query("d43_fidelity", f"{_COMPARED} SELECT symbol, day::VARCHAR AS day, dimension, agree, engine_rank, n_candidates, category FROM cp")
def _(spark, d):
    return marked(spark, d).withColumn("day", F.col("day").cast("string")).withColumn("engine_rank", F.col("engine_rank").cast("long"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE agree = false AND category = '{c}') AS {c}" for c in ("detector", "context", "ranking", "mechanization", "ambiguity"))


@query("d43_fidelity_counts", f"{_COMPARED} SELECT symbol, dimension, count(*) AS n, count(*) FILTER (WHERE agree) AS agreed, {_COUNTS} FROM cp GROUP BY symbol, dimension")
def _(spark, d):
    return R.disagreements(marked(spark, d), ["symbol"])


def considered(spark, d):
    """A candidate at each bar with what its close tells, the scene (four bars) and whether a picker would choose it.

    The pick stands in for a person's: the scene's largest body of at least half an
    average range, the earlier of equal ones.
    """
    span, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    bars = with_atr(spark, d).where("atr > 0 and high > low").withColumn("scene", F.floor(F.col("pos") / 4)).withColumn("body_", body)
    first = F.row_number().over(Window.partitionBy("symbol", "scene").orderBy(F.desc("body_"), "pos")) == 1
    hour = F.hour(eastern(F.col("ts")))
    return bars.select(
        "symbol", "scene", F.col("pos").cast("long").alias("row_id"), F.concat_ws(":", "symbol", "pos").alias("id"), (span / F.col("atr")).alias("span"),
        ((F.col("high") - F.greatest("open", "close")) / span).alias("upper"), ((F.least("open", "close") - F.col("low")) / span).alias("lower"), F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").alias("way"),
        F.when(hour < 3, "asia").when(hour < 9, "london").when(hour < 16, "new_york").otherwise("late").alias("session"), (first & (F.col("body_") >= 0.5 * F.col("atr"))).alias("chosen"),
    )


LEVELS = {"way": ["up", "down"], "session": ["asia", "london", "new_york", "late"]}


@query("ml07_penalty_path")
def _(spark, d):
    nxt = F.lead("close").over(in_time())
    frame = logs(spark, d).withColumn("label", F.when(nxt > F.col("close"), 2).when(nxt < F.col("close"), 0).when(nxt.isNotNull(), 1))
    test = L.penalty_path(frame, ["x1", "x2"], "label", [0, 1, 2], "symbol", "pos")
    own = F.element_at("proba", F.col("label") + 1)
    return test.groupBy("symbol", "fold", "chosen").agg(F.count("*").alias("n"), r6(F.avg(C.neg_log_likelihood(own)), "loss"))


def bracketed(spark, d):
    """An order at every bar's body middle between the extremes of the last six bars, both of which prices can reach.

    Brackets of average ranges would not do here: prices are positive and smaller
    than an average range, so no short could reach its target and hardly a long its
    stop, and the way alone would tell the outcome.
    """
    high, low = F.max("high").over(V.rows(-5, 0)), F.min("low").over(V.rows(-5, 0))
    frame = placed(spark, d).withColumn("top_", high).withColumn("bottom_", low).where("close <> open")
    long, middle = F.col("close") > F.col("open"), (F.col("open") + F.col("close")) / 2
    stop, target = F.when(long, F.col("bottom_")).otherwise(F.col("top_")), F.when(long, F.col("top_")).otherwise(F.col("bottom_"))
    orders = frame.select(F.concat_ws(":", "symbol", "pos").alias("id"), "symbol", (F.col("pos") + 1).alias("decision"), long.alias("is_long"), middle.alias("price"), stop.alias("stop"), target.alias("target"))
    return orders.where("stop <> price and target <> price")


@query("ml17_outcome_classifiers")
def _(spark, d):
    outcomes = O.labels(bracketed(spark, d), placed(spark, d), HORIZON)
    outcomes = outcomes.select("id", "decision", "final", F.when(F.col("result") == "TARGET", 1).when(F.col("result") == "STOP", 0).alias("label"))
    rows = considered(spark, d).join(outcomes, "id")
    out = R.classifiers(rows, ["span", "upper", "lower"], ["way", "session", "symbol"], "label", "decision", "final")
    return out.select("model", "n_train", "n_val", *(F.round(c, 4).alias(c) for c in ("positive_rate", "majority_accuracy", "auc", "accuracy")))


@query("ml18_choice_ranker")
def _(spark, d):
    out = L.choice_ranker(considered(spark, d), ["span", "upper", "lower"], LEVELS, "symbol")
    return out.select("symbol", F.col("row_id").alias("pos"), "scene", "chosen", "abstain", "p", "p_no_trade")


@query("ml19_case_deletion")
def _(spark, d):
    rows = considered(spark, d).withColumn("label", F.col("chosen").cast("int"))
    out = L.case_deletion(rows, ["span", "upper", "lower"], "symbol")
    return out.select("symbol", F.col("row_id").alias("pos"), "label", r6("p", "p"))


def frozen(spark, d, causal: bool):
    """Fit on the first seven tenths of each symbol's time, store, read back and score what comes after; zeros for symbols too short for a bundle."""
    features = B.CAUSAL if causal else X.MARKET_STATE
    rows = B.labelled(X.market_state(swings(spark, d), causal=causal), 5).select("symbol", "ts", "known_at", "atr", *features, "ahead", "label")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    ends = rows.groupBy("symbol").agg(F.min(seconds).alias("a"), F.max(seconds).alias("b"))
    until = F.timestamp_seconds(F.floor(F.col("a") + (F.col("b") - F.col("a")) * 0.7)).cast("timestamp_ntz")
    rows = written(rows.join(ends.select("symbol", until.alias("until")), "symbol"), "matrix")
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    stores.save_bundle(B.build(rows, features, F.col("until"), cost=6.0, point_value=2.0, settled=causal), path, horizon="5", left_out=",".join(B.LEAKY if causal else []))
    bundle, _ = stores.load_bundle(spark, path)
    ahead = B.score(rows.where("ts > until"), bundle, features)
    own = -F.ln(F.greatest(F.element_at("proba", F.col("label") + 1), F.lit(1e-15)))
    judged = ahead.groupBy("symbol").agg(F.count("ev").alias("n_scored"), r6(F.avg(own), "loss"), r6(F.avg("ev"), "mean_ev"), F.count_if(F.abs("ev") > F.col("cost_hurdle")).alias("n_beyond_cost"))
    fitted = bundle.select("symbol", "n_train", F.size("features").alias("n_features"))
    out = ends.select("symbol").join(fitted, "symbol", "left").join(judged, "symbol", "left")
    return out.fillna(0, ["n_train", "n_features", "n_scored", "n_beyond_cost"])


@query("ml15_frozen_bundle")
def _(spark, d):
    return frozen(spark, d, causal=False)


@query("ml16_causal_bundle")
def _(spark, d):
    return frozen(spark, d, causal=True)
