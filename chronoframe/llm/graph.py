"""Connected components by alternating large-star and small-star rounds, on Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, hot_aware_join


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    ``edges`` has long columns a and b; null ends and loops are ignored, repeats are harmless,
    an empty table gives an empty result. Each round is two shuffles of the edges with
    map-side minima and a written table, so that a lost executor costs one round at most; the edges of
    a hub stay where they lie. Rounds end when the edges are stars around their minima; their number grows
    with the logarithm of the longest chain.
    """

    now = scratch.keep(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    turn, total = 0, now.count()
    while total:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_aware_join(both, least, "u", "n", 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{name}-large")
        joined = hot_aware_join(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", "n", total)
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = scratch.keep(small, f"{name}-{turn + 1}")
        # Stars only: no leaf has two centres, and none is a centre.
        ends = small.select(F.explode(F.array(F.struct(F.col("u").alias("w"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("w"), F.lit(0).alias("leaf")))).alias("e"))
        roles = ends.groupBy("e.w").agg(F.sum("e.leaf").alias("as_leaf"), F.min("e.leaf").alias("only_leaf"))
        state = roles.agg(F.sum("as_leaf").alias("n"), F.max("as_leaf").alias("most"), F.max((F.col("as_leaf") > F.col("only_leaf"))).alias("both")).first()
        done = state.most == 1 and not state.both
        scratch.drop(f"{name}-{turn}", f"{name}-large")
        now, turn, total = small, turn + 1, state.n
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
