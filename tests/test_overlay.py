"""The overlay grid's settings differ wherever a target is met."""

from barspark import catalog


def test_every_setting_of_the_grid_counts(spark):
    rows = catalog.QUERIES["ml21_overlay_grid"](spark, "/root/testdata/sf0.01").collect()
    by_symbol = {}
    for r in rows:
        by_symbol.setdefault(r.symbol, set()).add((r.n, r.mean, r.total))
    assert len(rows) == 4 * len(by_symbol) and all(len(v) >= 2 for v in by_symbol.values())
    assert len(by_symbol["click"]) == 4  # both targets are met under both stops
