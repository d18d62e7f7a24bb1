"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Links each node's neighbours to its least one: those above the node (large), or those below it with itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return linked.filter("u != v")


def _state(edges: DataFrame):
    """The count of distinct edges and three sums, two of them of 64-bit hashes: equal tables have equal states, others do not but by chance under 2^-100."""
    sums = [F.sum(F.col("u").cast("decimal(38,0)") - F.col("v")), *(F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2))]
    return edges.agg(F.count("*"), *sums).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u long, v long); root is the component's least node.

    Each round is written to the shared folder, so that a lost executor costs one round at most. Self-loops are
    ignored; an empty table gives an empty one. A star's centre is reduced by map-side minima, so that a node with
    very many neighbours is no hot group.
    """
    edges = stored(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u != v").distinct())
    state = _state(edges)
    for _ in range(rounds):
        was, edges = edges, stored(_star(_star(edges, True), False))
        release(was)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
