"""Trade statistics over trades derived from hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.catalog import query
from barspark.catalog.bars import placed, r6, ticks
from barspark.catalog.sql import POS, TICKS
from barspark.functions.session import eastern
from barspark.operators.windows import in_time
from barspark.plans import resample as R
from barspark.plans import stats as S

_TR = f"""{POS}, tr AS (
  SELECT symbol, pos, epoch(ts)::BIGINT AS entry, epoch(lead(ts, 4) OVER w)::BIGINT AS exit, lead(close, 4) OVER w - close AS pnl, (lead(close, 4) OVER w - close) / 50.0 AS r,
    CASE WHEN hour(et) < 8 THEN 'night' WHEN hour(et) < 16 THEN 'day' END AS setup, CASE WHEN close > open THEN 'long' ELSE 'short' END AS side, et::DATE AS day
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts) QUALIFY lead(ts, 4) OVER w IS NOT NULL
)"""


def trades(spark, d):
    frame = placed(spark, d).withColumn("et", eastern(F.col("ts")))
    pnl = F.lead("close", 4).over(in_time()) - F.col("close")
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    out = frame.select(
        "symbol", "pos", seconds(F.col("ts")).alias("entry"), seconds(F.lead("ts", 4).over(in_time())).alias("exit"), pnl.alias("pnl"), (pnl / 50.0).alias("r"),
        F.when(F.hour("et") < 8, "night").when(F.hour("et") < 16, "day").alias("setup"), F.when(F.col("close") > F.col("open"), "long").otherwise("short").alias("side"), F.to_date("et").alias("day"),
    )
    return out.where("exit is not null")


_SUMMARY = """count(*) AS n, round(avg((pnl > 0)::INT), 6) AS win_rate, round(avg(r), 6) AS avg_r,
  round(CASE WHEN coalesce(-sum(pnl) FILTER (WHERE pnl <= 0), 0) > 0 THEN coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / -sum(pnl) FILTER (WHERE pnl <= 0) ELSE 'inf'::DOUBLE END, 6) AS profit_factor, round(sum(pnl), 6) AS total_pnl,
  round(coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0), 6) AS avg_win, round(coalesce(avg(pnl) FILTER (WHERE pnl <= 0), 0), 6) AS avg_loss, round(max(pnl), 6) AS largest_win, round(min(pnl), 6) AS largest_loss"""


def rounded(frame, keys):
    return frame.select(*keys, "n", *(r6(c, c) for c in S.trade_aggregates() if c != "n"))


@query("g05_trade_stats", f"{_TR} SELECT symbol, {_SUMMARY} FROM tr GROUP BY symbol")
def _(spark, d):
    return rounded(S.summary(trades(spark, d), ["symbol"]), ["symbol"])


@query("g06_in_and_out_of_sample", f"{_TR} SELECT symbol, CASE WHEN entry < 1705708800 THEN 'in' ELSE 'out' END AS sample, {_SUMMARY} FROM tr GROUP BY ALL")
def _(spark, d):
    frame = trades(spark, d).withColumn("sample", F.when(F.col("entry") < 1705708800, "in").otherwise("out"))
    return rounded(S.summary(frame, ["symbol", "sample"]), ["symbol", "sample"])


@query("g07_breakdown_by_setup", f"{_TR} SELECT setup, {_SUMMARY} FROM tr GROUP BY setup")
def _(spark, d):
    return rounded(S.summary(trades(spark, d), ["setup"]), ["setup"])


@query("g08_all_breakdowns", f"""{_TR}, c AS (SELECT *, 'all' AS dimension, '' AS value FROM tr UNION ALL SELECT *, 'symbol', symbol FROM tr UNION ALL SELECT *, 'setup', setup FROM tr UNION ALL SELECT *, 'side', side FROM tr)
SELECT dimension, value, {_SUMMARY} FROM c GROUP BY dimension, value""")
def _(spark, d):
    return rounded(S.breakdowns(trades(spark, d), ["symbol", "setup", "side"]), ["dimension", "value"])


@query("g13_grouping_sets", f"{_TR} SELECT symbol, side, count(*) AS n FROM tr GROUP BY GROUPING SETS ((symbol), (side), ())")
def _(spark, d):
    return S.cube_counts(trades(spark, d), ["symbol", "side"], F.count("*").alias("n"))


@query("g38_streaks", f"""{_TR}, m AS (SELECT *, CASE WHEN (pnl > 0) IS DISTINCT FROM lag(pnl > 0) OVER w THEN 1 ELSE 0 END AS ch FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY entry)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY entry ROWS UNBOUNDED PRECEDING) AS run FROM m), g AS (SELECT symbol, run, pnl > 0 AS win, count(*) AS n FROM i GROUP BY ALL)
SELECT symbol, coalesce(max(n) FILTER (WHERE win), 0) AS max_wins, coalesce(max(n) FILTER (WHERE NOT win), 0) AS max_losses FROM g GROUP BY symbol""")
def _(spark, d):
    return S.streaks(trades(spark, d), "symbol", "entry")


@query("w28_drawdowns", f"""{_TR}, c AS (SELECT *, 50000 + sum(pnl) OVER w AS eq FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY entry ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(50000, max(eq) OVER w) AS pk FROM c WINDOW w AS (PARTITION BY symbol ORDER BY entry ROWS UNBOUNDED PRECEDING))
SELECT symbol, round(min(eq - pk), 6) AS drawdown, round(min(eq / pk - 1), 6) AS drawdown_share, round(arg_max(eq, entry), 6) AS final_equity FROM p GROUP BY symbol""")
def _(spark, d):
    out = S.drawdowns(trades(spark, d), "symbol", "entry", 50000.0)
    return out.select("symbol", *(r6(c, c) for c in ("drawdown", "drawdown_share", "final_equity")))


@query("g10_walk_forward_windows", f"""{_TR}, s AS (SELECT symbol, min(entry) AS lo, max(entry) AS hi FROM tr GROUP BY symbol), c AS (SELECT tr.*, least(5, floor((entry - lo) / greatest((hi - lo) / 6, 1e-9)))::INT AS w FROM tr JOIN s USING (symbol)),
g AS (SELECT symbol, w, count(*) AS n, sum(pnl) AS pnl, avg(r) AS avg_r FROM c GROUP BY ALL)
SELECT s.symbol, t.w::INT AS w, coalesce(n, 0) AS n, round(coalesce(pnl, 0), 6) AS pnl, round(avg_r, 6) AS avg_r FROM s CROSS JOIN range(6) t(w) LEFT JOIN g ON g.symbol = s.symbol AND g.w = t.w""")
def _(spark, d):
    return S.walk_forward(trades(spark, d), "symbol", "entry", 6).select("symbol", "w", "n", r6("pnl", "pnl"), r6("avg_r", "avg_r"))


@query("g11_walk_forward_consistency", f"""{_TR}, s AS (SELECT symbol, min(entry) AS lo, max(entry) AS hi FROM tr GROUP BY symbol), c AS (SELECT tr.*, least(5, floor((entry - lo) / greatest((hi - lo) / 6, 1e-9)))::INT AS w FROM tr JOIN s USING (symbol)),
g AS (SELECT symbol, w, sum(pnl) AS pnl, avg(r) AS avg_r FROM c GROUP BY ALL)
SELECT symbol, count(*) FILTER (WHERE pnl > 0) AS winning, round(avg(avg_r), 6) AS mean_r, round(stddev_samp(avg_r), 6) AS spread_r FROM g GROUP BY symbol""")
def _(spark, d):
    table = S.walk_forward(trades(spark, d), "symbol", "entry", 6)
    return table.groupBy("symbol").agg(F.count_if(F.col("pnl") > 0).alias("winning"), r6(F.avg("avg_r"), "mean_r"), r6(F.stddev_samp("avg_r"), "spread_r"))


@query("g15_by_month", f"{_TR} SELECT symbol, strftime(date_trunc('month', day), '%Y-%m') AS month, {_SUMMARY} FROM tr GROUP BY ALL")
def _(spark, d):
    return rounded(S.summary(trades(spark, d).withColumn("month", F.date_format("day", "yyyy-MM")), ["symbol", "month"]), ["symbol", "month"])


@query("g16_capped_results", f"{_TR}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r DESC, pos) AS rn FROM tr) SELECT symbol, round(avg(least(r, 5)), 6) AS capped, round(sum(r) FILTER (WHERE rn <= 5), 6) AS top5 FROM k GROUP BY symbol")
def _(spark, d):
    frame = trades(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("r").desc(), "pos")))
    return frame.groupBy("symbol").agg(r6(F.avg(F.least("r", F.lit(5.0))), "capped"), r6(F.sum(F.when(F.col("rn") <= 5, F.col("r"))), "top5"))


@query("g17_nearest_rank_quantiles", f"{_TR}, l AS (SELECT symbol, list_sort(list(r)) AS v FROM tr GROUP BY symbol) SELECT symbol, round(v[least(len(v), floor(0.25 * len(v))::INT + 1)], 6) AS q25, round(v[least(len(v), floor(0.9 * len(v))::INT + 1)], 6) AS q90 FROM l")
def _(spark, d):
    return S.nearest_ranks(trades(spark, d), "r", {"q25": 0.25, "q90": 0.9}, "symbol").select("symbol", r6("q25", "q25"), r6("q90", "q90"))


@query("g20_daily_pnl", f"{_TR} SELECT symbol, day::VARCHAR AS day, round(sum(pnl), 6) AS pnl, round(sum(r), 6) AS r FROM tr GROUP BY symbol, day")
def _(spark, d):
    return trades(spark, d).groupBy("symbol", F.col("day").cast("string").alias("day")).agg(r6(F.sum("pnl"), "pnl"), r6(F.sum("r"), "r"))


@query("j12_calendar_fill", f"""{_TR}, k AS (SELECT symbol, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM tr GROUP BY symbol), g AS (SELECT symbol, day, sum(pnl) AS pnl FROM tr WHERE side = 'long' GROUP BY ALL)
SELECT k.symbol, k.day::VARCHAR AS day, round(coalesce(pnl, 0), 6) AS pnl FROM k LEFT JOIN g ON g.symbol = k.symbol AND g.day = k.day""")
def _(spark, d):
    rows = trades(spark, d)
    # every calendar day from a symbol's first to its last
    grid = rows.groupBy("symbol").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    sums = rows.where("side = 'long'").groupBy("symbol", "day").agg(F.sum("pnl").alias("pnl"))
    return grid.join(sums, ["symbol", "day"], "left").select("symbol", F.col("day").cast("string").alias("day"), r6(F.coalesce("pnl", F.lit(0.0)), "pnl"))


@query("st07_daily_sharpe", f"{_TR}, g AS (SELECT symbol, day, sum(pnl) AS pnl FROM tr GROUP BY ALL) SELECT symbol, round(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0 END, 6) AS sharpe FROM g GROUP BY symbol")
def _(spark, d):
    daily = trades(spark, d).groupBy("symbol", "day").agg(F.sum("pnl").alias("pnl"))
    return S.sharpe(daily, "symbol").select("symbol", r6("sharpe", "sharpe"))


@query("g32_drop_best_week", f"""{_TR}, g AS (SELECT symbol, day, sum(pnl) AS pnl FROM tr GROUP BY ALL), w AS (SELECT *, date_trunc('week', day) AS wk, sum(pnl) OVER (PARTITION BY symbol, date_trunc('week', day)) AS s FROM g),
b AS (SELECT symbol, first(wk ORDER BY round(s, 9) DESC, wk) AS best FROM w GROUP BY symbol) SELECT symbol, round(avg(pnl), 6) AS mean FROM w JOIN b USING (symbol) WHERE wk <> best GROUP BY symbol""")
def _(spark, d):
    daily = trades(spark, d).groupBy("symbol", "day").agg(F.sum("pnl").alias("pnl"))
    return S.drop_best(daily, "symbol", F.date_trunc("week", "day").cast("date")).select("symbol", r6("mean", "mean"))


@query("t03_stratified_round_robin", f"""{_TR}, k AS (SELECT *, row_number() OVER (PARTITION BY side, symbol ORDER BY abs(r) DESC, pos) AS rn FROM tr), q AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY rn, symbol) AS place FROM k) SELECT side, symbol, pos, place FROM q WHERE place <= 12""")
def _(spark, d):
    frame = trades(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("side", "symbol").orderBy(F.abs("r").desc(), "pos")))
    frame = frame.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy("rn", "symbol"))).where("place <= 12")
    return frame.select("side", "symbol", F.col("pos").cast("long").alias("pos"), F.col("place").cast("long").alias("place"))


@query("t01_top_queue", f"{_TR} SELECT symbol, pos, round(r, 6) AS score FROM tr ORDER BY abs(r) DESC, symbol, pos LIMIT 20")
def _(spark, d):
    return trades(spark, d).orderBy(F.abs("r").desc(), "symbol", "pos").limit(20).select("symbol", F.col("pos").cast("long").alias("pos"), r6("r", "score"))


@query("t07_first_per_day", f"{_TR} SELECT symbol, day::VARCHAR AS day, min(pos) AS pos FROM tr GROUP BY symbol, day")
def _(spark, d):
    rows = trades(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("symbol", "day").orderBy("pos"))).where("at = 1")
    return rows.select("symbol", F.col("day").cast("string").alias("day"), F.col("pos").cast("long").alias("pos"))


@query("g31_day_efficiency", f"""{POS}, s AS (SELECT symbol, et::DATE AS day, close, ts, abs(close - lag(close) OVER (PARTITION BY symbol, et::DATE ORDER BY ts)) AS step FROM x)
SELECT symbol, day::VARCHAR AS day, round(CASE WHEN sum(step) > 0 THEN abs(arg_max(close, ts) - arg_min(close, ts)) / sum(step) END, 6) AS er FROM s GROUP BY symbol, day""")
def _(spark, d):
    frame = placed(spark, d).withColumn("day", F.to_date(eastern(F.col("ts"))))
    step = F.abs(F.col("close") - F.lag("close").over(Window.partitionBy("symbol", "day").orderBy("ts")))
    path = F.sum("step")
    er = F.when(path > 0, F.abs(F.max_by("close", "ts") - F.min_by("close", "ts")) / path)
    return frame.withColumn("step", step).groupBy("symbol", "day").agg(r6(er, "er")).withColumn("day", F.col("day").cast("string"))


@query("g34_audit_counters", f"{_TR} SELECT symbol, count(*) AS n, count(*) FILTER (WHERE setup IS NULL) AS no_setup, count(DISTINCT day) AS days, count(DISTINCT setup) AS setups FROM tr GROUP BY symbol")
def _(spark, d):
    return trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("setup").isNull()).alias("no_setup"), F.count_distinct("day").alias("days"), F.count_distinct("setup").alias("setups"))


@query("s13_payload_reasons", f"""WITH {TICKS}, p AS (SELECT event_id, ts, value, props, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k IS NULL THEN 'bad_schema' WHEN value <= 0 THEN 'bad_price' WHEN k % 10 = 0 THEN 'unknown_symbol' END AS reason FROM p""")
def _(spark, d):
    from barspark.sources import tables

    events = tables.table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    reason = F.when(F.col("k").isNull(), "bad_schema").when(F.col("value") <= 0, "bad_price").when(F.col("k") % 10 == 0, "unknown_symbol")
    return events.select("event_id", reason.alias("reason"))


@query("st01_bootstrap_mean")
def _(spark, d):
    return R.bootstrap_mean(trades(spark, d), "r", "symbol", order="entry")


@query("st04_circular_block_bootstrap")
def _(spark, d):
    daily = trades(spark, d).groupBy("symbol", F.unix_date("day").alias("day")).agg(F.sum("r").alias("r"))
    return R.bootstrap_mean(daily, "r", "symbol", draws=5000, block=5, order="day", seed=20260724)


@query("g01_tick_counts", f"WITH {TICKS} SELECT symbol, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM ticks GROUP BY symbol")
def _(spark, d):
    return ticks(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))
