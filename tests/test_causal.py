"""What was known at a bar is what the chain finds on the bars up to it."""

import random

import pytest
from pyspark.sql import functions as F

from barspark.catalog.bars import placed
from barspark.operators import structure as D
from barspark.plans import causal
from barspark.plans import setups as P

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bars(spark):
    from barspark.sources.shared import written

    return written(placed(spark, SMALL).where("pos < 260").select("symbol", "ts", "open", "high", "low", "close", "volume", "pos"), "cut")


@pytest.fixture(scope="module")
def known(bars):
    return causal.Known(bars)


@pytest.fixture(scope="module")
def cursors():
    return sorted(random.Random(4).sample(range(20, 260), 20))


@pytest.fixture(scope="module")
def cut(bars, cursors):
    """For each cursor a copy of the bars up to it, under a symbol of its own, so that the chain runs once for all."""
    from barspark.sources.shared import written

    copies = bars.withColumn("cursor", F.explode(F.array(*map(F.lit, cursors)))).where("pos <= cursor")
    return written(copies.withColumn("symbol", F.concat_ws("@", "symbol", "cursor")).drop("cursor"), "copies")


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def at_cursors(frame, cursors, name="symbol"):
    out = frame.withColumn("cursor", F.explode(F.array(*map(F.lit, cursors)))).where("known_from <= cursor and known_to > cursor")
    return out.withColumn(name, F.concat_ws("@", "symbol", "cursor"))


def test_structural_swings(known, cut, cursors):
    got = rows(at_cursors(known.legs, cursors), "symbol", "kind", "pos", "price")
    assert got and got == rows(D.skeleton(D.pivots(cut)), "symbol", "kind", "pos", "price")


def test_shifts(known, cut, cursors):
    # the chain takes a displacement's end from pivots that a later bar has confirmed
    got = at_cursors(known.shifts, cursors)
    state = F.when(F.col("confirm_pos") <= F.col("cursor"), "confirmed").when(F.col("wick_pos") <= F.col("cursor"), "candidate").otherwise("potential")
    got = rows(got.withColumn("state", state), "symbol", "level_pos", "way", "sweep_pos", "end_pos", "broken_pos", "broken_price", "state")
    assert got and got == rows(P.shifts(cut), "symbol", "level_pos", "way", "sweep_pos", "end_pos", "broken_pos", "broken_price", "state")


def test_gaps_and_their_owners(known, cut, cursors):
    got = at_cursors(known.gaps, cursors)
    status = F.when(F.col("mitigated_pos") <= F.col("cursor"), "mitigated").when(F.col("touch_pos") <= F.col("cursor"), "touched").otherwise("unfilled")
    got = rows(got.withColumn("status", status), "symbol", "formed_pos", "way", "sweep_pos", "level_pos", "middle", "extreme", "status")
    assert got and got == rows(P.imbalances(cut, P.shifts(cut)), "symbol", "formed_pos", "way", "sweep_pos", "level_pos", "middle", "extreme", "status")


def test_setups_lifecycle_and_decisions(known, cut, cursors):
    live = known.lifecycle(known.live_setups()).where(F.col("pos").isin(cursors)).withColumn("symbol", F.concat_ws("@", "symbol", "pos"))
    columns = ["symbol", "formed_pos", "way", "sweep_pos", "entry", "stop", "target", "rr", "reject", "status", "state"]
    chain = P.setups(cut)
    whole = P.lifecycle(chain.withColumnRenamed("state", "shift_state"), cut).where("status <> 'mitigated'")
    got = rows(live, *columns)
    assert got and got == rows(whole, *columns)
    best = {}
    for r in whole.where("state = 'current'").collect():
        key = (-r.rr, round(r.risk, 2), r.formed_pos, r.way)
        if r.symbol not in best or key < best[r.symbol][0]:
            best[r.symbol] = (key, "LONG" if r.way == 1 else "SHORT", r.entry)
    decided = known.decisions().where(F.col("pos").isin(cursors)).collect()
    assert len(decided) == len({r.symbol for r in decided}) * len(cursors)
    for r in decided:
        want = best.get(f"{r.symbol}@{r.pos}")
        assert (r.decision, r.entry) == ((want[1], want[2]) if want else ("NO-TRADE", None))


def test_counts_at_every_bar(known, cut, cursors):
    got = {f"{r.symbol}@{r.pos}": r for r in known.states().where(F.col("pos").isin(cursors)).collect()}
    pools = D.pools(D.pivots(cut), cut)
    want = {
        "n_pools": pools.where("hit_pos is null"), "n_sweeps": pools.where("swept"), "n_displacements": P.moves(cut),
        "n_shifts": P.shifts(cut), "n_gaps": P.imbalances(cut, P.shifts(cut)),
    }
    for name, frame in want.items():
        counts = {r.symbol: r["count"] for r in frame.groupBy("symbol").count().collect()}
        assert {k: r[name] for k, r in got.items()} == {k: counts.get(k, 0) for k in got}, name
    ranges = {r.symbol: (r.range_high, r.range_low) for r in D.dealing_range(D.skeleton(D.pivots(cut))).collect()}
    assert {k: (r.range_high, r.range_low) for k, r in got.items()} == {k: ranges.get(k, (None, None)) for k in got}


def test_tickets(known, cut, cursors):
    """Each ticket from the chain on cut bars: its best current setup, judged in the dealing range by the formula written out."""
    whole = P.lifecycle(P.setups(cut).withColumnRenamed("state", "shift_state"), cut).where("status <> 'mitigated' and state = 'current'").collect()
    ranges = {r.symbol: (r.range_high, r.range_low) for r in D.dealing_range(D.skeleton(D.pivots(cut))).collect()}
    best = {}
    for r in sorted(whole, key=lambda r: (-r.rr, round(r.risk, 2), r.formed_pos, r.way)):
        best.setdefault(r.symbol, r)
    seen = set()
    for t in known.tickets("60m").where(F.col("pos").isin(cursors)).collect():
        want, (high, low) = best.get(f"{t.symbol}@{t.pos}"), ranges.get(f"{t.symbol}@{t.pos}", (None, None))
        if want is None:
            assert (t.action, t.execution, t.confidence, t.entry, t.exit_target, t.issues) == ("NO_SETUP", "N/A", 0.0, None, None, "")
            continue
        assert (t.entry, t.stop, t.target, t.rr) == (want.entry, want.stop, want.target, want.rr) and t.ticket.startswith(f"{t.symbol}:60m:20")
        assert t.exit_target == pytest.approx(want.entry + want.way * 2 * abs(want.entry - want.stop), abs=1e-4)
        if high is None or low is None:
            assert (t.action, t.execution, t.confidence) == ("SKIP", "N/A", 0.0)
            continue
        middle, clamp = (high + low) / 2, lambda x: max(0.0, min(1.0, x))
        place = clamp((middle - want.entry) / ((middle - low) or 1e-9) if want.way == 1 else (want.entry - middle) / ((high - middle) or 1e-9))
        near = clamp(1 - abs(want.entry - middle) / (0.5 * ((high - low) or 1e-9)))
        assert t.confidence == pytest.approx(0.6 * place + 0.4 * near, abs=2e-4) and t.weakest == ("pd_location" if round(place, 4) <= round(near, 4) else "ce_distance")
        assert (t.action, t.execution) == (("TAKE", "TRADE") if t.confidence >= 0.39 else ("SKIP", "PASS"))
        assert t.issues.split(",") == ([n for v, n in sorted([(place, "pd_location"), (near, "ce_distance")], key=lambda e: e[0]) if v < 0.5] or [""])
        seen.add(t.action)
    assert seen
