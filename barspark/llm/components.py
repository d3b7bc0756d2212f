"""Connected components of a table of undirected edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Workspace


def connected_components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the smallest vertex it can reach.

    Each round hooks a vertex to its smallest smaller neighbour, shortens the
    resulting trees by pointer jumping and replaces the edges by those between
    the roots.  A hub's edges meet only in a partial minimum and in joins that
    adaptive execution may split.  Rounds grow with the logarithm of the graph.
    Returns (id, component); empty edges give no rows.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = work.table(f"{name}-edges-0", edges)
    labels = None
    step = 0
    while not edges.isEmpty():
        step += 1
        roots = work.table(f"{name}-roots-{step}-0", edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")))
        jump = 0
        while True:
            above = roots.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            if roots.join(above, "up", "left_semi").isEmpty():
                break
            jump += 1
            roots = work.table(
                f"{name}-roots-{step}-{jump}",
                roots.join(above, "up", "left").select("id", F.coalesce("upper", "up").alias("up")),
            )
            work.drop(f"{name}-roots-{step}-{jump - 1}")
        if labels is None:
            labels = roots.select("id", F.col("up").alias("component"))
        else:
            hooked = roots.select(F.col("id").alias("component"), "up")
            labels = (
                labels.join(hooked, "component", "left")
                .select("id", F.coalesce("up", "component").alias("component"))
                .unionByName(roots.join(labels.select("id"), "id", "left_anti").select("id", F.col("up").alias("component")))
            )
        labels = work.table(f"{name}-labels-{step}", labels)
        ends = roots.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        ends_b = roots.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        edges = work.table(
            f"{name}-edges-{step}",
            edges.join(ends, "a", "left")
            .join(ends_b, "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct(),
        )
        work.drop(f"{name}-edges-{step - 1}", f"{name}-labels-{step - 1}")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where("false")
    smallest = labels.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return labels.unionByName(smallest.join(labels.select("id"), "id", "left_anti"))
