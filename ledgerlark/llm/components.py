"""Distributed connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import dropped, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Each round every node follows the neighbour of least random priority, twice, and the edges are rewritten to
    what remains. Priorities change from round to round, so that chains shrink by a constant factor and the rounds
    grow with the logarithm of the longest chain. No step gathers a node's neighbours: minima combine before the
    shuffle and the joins meet one row for each node, so that Spark can split a hot node's edges.
    Null ends, loops and repeated edges are left out; no edges give an empty result.
    """

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    left = saved(ordered(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))))
    first, levels = left, []
    while not left.isEmpty():
        salt = F.lit(len(levels))
        both = left.union(left.select("v", "u"))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min(F.struct(F.xxhash64("v", salt).alias("h"), "v")).alias("m"))
        mine = F.struct(F.xxhash64("x", salt).alias("h"), F.col("x").alias("v"))
        parent = saved(least.select("x", F.least("m", mine)["v"].alias("p")))
        hop = saved(parent.alias("s").join(parent.alias("t"), F.col("s.p") == F.col("t.x")).select("s.x", "t.p"))
        dropped(parent)
        levels.append(hop)
        moved = left.join(hop, F.col("u") == F.col("x")).select(F.col("p").alias("u"), "v")
        moved = moved.join(hop, F.col("v") == F.col("x")).select("u", F.col("p").alias("v"))
        now = saved(ordered(moved))
        dropped(left)
        left = now
    if not levels:
        return first.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = levels[0]
    for hop in levels[1:]:
        later = hop.select(F.col("x").alias("y"), F.col("p").alias("q"))
        label = label.join(later, F.col("p") == F.col("y"), "left").select("x", F.coalesce("q", "p").alias("p"))
    label = saved(label)
    for hop in levels:
        dropped(hop)
    least = label.groupBy("p").agg(F.min("x").alias("component"))
    return label.join(least, "p").select(F.col("x").alias("node"), "component")
