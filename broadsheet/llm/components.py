"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import cut, lookup

#: Edges of a node up to which they are joined by a plain shuffle; with more, hot nodes are looked up apart.
HUB = 50_000


def _with_least(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """Edges (a, b) with m, the least known of a."""
    return lookup(edges, least, "a", "edges", ["m"]) if hubs else edges.join(least.select("a", "m"), "a")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, of every node in `edges` (columns a and b, longs).

    In turn every node hands its larger neighbours to its smallest one, and then its smaller ones and
    itself, until all nodes but the roots have one edge. The edges come down to stars in a number of rounds
    that grows as a logarithm; each round is two aggregations and two joins. The middle of a star has as
    many edges as its star has nodes; with more than HUB the joins go through lookup(). Loops and repeated
    edges do no harm; an empty table gives one.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("edges")))
        state = least.agg(F.max("edges").alias("most"), F.count_if((F.col("m") < F.col("a")) & (F.col("edges") > 1)).alias("open")).first()
        if not state["open"]:
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        hubs = state["most"] > HUB
        large = _with_least(both, least, hubs).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large)
        below = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("edges"))
        small = _with_least(large, below, hubs)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.m").alias("b"))
        now = cut(small.filter("a <> b").distinct())
