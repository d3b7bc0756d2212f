"""Reachability over edges of any depth, with cycles and nulls."""

from barspark.operators.structure import ancestors


def test_chains_are_followed_to_their_end(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "n7"), ("n12", "n2"), ("a", "b"), ("b", "a"), (None, "n1"), ("n1", None)]
    frame = spark.createDataFrame(edges, "child string, parent string")
    start = spark.createDataFrame([("x", "n0"), ("x", "n0"), ("y", "a"), ("z", "alone")], "root string, node string")
    got = {(r.root, r.node): r.depth for r in ancestors(frame, start).collect()}
    want = {("x", f"n{i}"): i if i < 4 else i if i < 7 else i - 3 for i in range(13)} | {("y", "a"): 0, ("y", "b"): 1, ("z", "alone"): 0}
    assert got == want


def test_nothing_to_start_from(spark):
    edges = spark.createDataFrame([("a", "b")], "child string, parent string")
    assert ancestors(edges, spark.createDataFrame([], "root string, node string")).count() == 0
