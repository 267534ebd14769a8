"""Connected components by alternating large-star and small-star steps, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Parts that the edges of one node are dealt into, by the other end.
SPLIT = 64


def _with_least(edges: DataFrame, own: bool) -> DataFrame:
    """(u, v, m): each edge with the least v of its u, or with u itself where that is less (own). The edges of a hub
    meet in up to SPLIT tasks: each part has its least, and a node's parts, no more than SPLIT, share the least of them."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SPLIT)))
    of_part = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    of_node = of_part.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    least = F.least("u", "m") if own else F.col("m")
    spread = of_node.select("u", least.alias("m"), F.explode("parts").alias("part"))
    return dealt.join(spread, ["u", "part"]).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any direction, repeats allowed -> (id long, component_id long).

    component_id is the smallest id reachable. Ids that occur in no edge are not listed; null ends and loops are
    ignored; an empty table gives an empty result. Each step points nodes at the least neighbour, so a hub's list
    shrinks by aggregation (min) and is never collected, and its edges are dealt into parts; each round's edges are
    written to the shared folder, and the round before is deleted. Two rounds are equal if their number of edges and
    two 64-bit digests of them are.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = stored(e.distinct(), "cc")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, own=True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _with_least(large, own=False).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        before, e = e, stored(small.select("x.u", "x.v").filter("u <> v").distinct(), "cc")
        discard(before)
        # stable once every node has one parent and no parent is a child
        h = F.xxhash64("u", "v")
        state = e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return roots.union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
