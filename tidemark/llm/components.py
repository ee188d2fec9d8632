"""Connected components of an edge table, with DataFrame operations only.

Alternates the large-star and small-star steps of Kiveris et al. (2014): the
edge set only ever shrinks to stars around each component's smallest node. Each
step aggregates minima on the map side first; a hub's edges are joined on, never
gathered. Every round is checkpointed in the shared folder, so lineage stays
short and a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without edges don't occur. Null ends and loops are no edges."""
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(f"{src} is not null and {dst} is not null and {src} != {dst}").distinct()
    e = materialize(e, "components")
    for _ in range(max_rounds):
        # Large star: neighbours above a node go to the smallest node around it.
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "components")
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = materialize(small, "components")
        # Done when every node has one edge, to a node that has none upward.
        twice = small.groupBy("a").count().where("count > 1")
        chained = small.select(F.col("b").alias("x")).join(small.select(F.col("a").alias("x")), "x", "left_semi")
        e = small
        if twice.isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select("b", "b").distinct())
