"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _roots(parents: DataFrame) -> DataFrame:
    """node, root of a forest (node, root <= node), by pointer jumping."""
    now = stored(parents)
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stored(now.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
        discard(now)
        now = new
        if not now.where("moved").limit(1).count():
            return now.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> node, root: the smallest node of its component.

    Every round ties each node to its least neighbour (partial minima, so a node of
    very high degree is combined before the shuffle), follows the ties to their
    ends and keeps only the edges between different ends.  At most half of the
    nodes are left after a round, usually far fewer.  Nodes without an edge to
    another node don't appear; loops, nulls and repeats do no harm.
    """
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = stored(edges.where("a <> b").select(sides).select("e.a", "e.b").distinct())
    found = None
    while found is None or both.limit(1).count():
        ends = _roots(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        if found is None:
            found = ends
        else:
            later = ends.select(F.col("node").alias("root"), F.col("root").alias("last"))
            found = found.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        left = both.join(ends.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        left = left.join(ends.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        new = stored(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        discard(both)
        both = new
    return found
