"""Connected components by randomised contraction: joins and sums only, no hub and no whole component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.scratch import release, stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (``a``, ``b`` long); equal roots: same component.

    In each round a node joins the neighbour, or itself, that comes first in an order drawn anew for
    the round, and edges are rewritten to those; the expected number of nodes left falls by a constant
    factor, whatever the shape. Self-loops and repeated edges are allowed; without edges the result is empty.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(rounds))
        both = edges.union(edges.select("b", "a"))
        near = F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("v"))
        least = both.groupBy("a").agg(F.min(near).alias("near"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("v"))
        step = stage(least.select("a", F.least("near", own)["v"].alias("to")), "step")
        rounds.append(step)
        moved = edges.join(step, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(step, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        fewer = stage(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(edges)
        edges = fewer
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in rounds[1:]:
        found = found.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
