"""Connected components by alternating large-star and small-star, as DataFrame operations.

Every step replaces edges by edges to the smallest neighbour; the number of edges doesn't grow, and a
centre with very many neighbours costs a partial minimum and an equi-join that Spark can split.  Each
round is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def partial_labels(edges: DataFrame, work: shared.Workspace, rounds: int) -> DataFrame:
    """(u, v) after a few rounds: nodes with one v are connected, but not all connected ones have one yet."""
    now = edges.select("u", "v").where(F.col("u") != F.col("v"))
    for _ in range(rounds):
        now = work.keep(small_star(large_star(now)))
    return now


def components(edges: DataFrame, work: shared.Workspace) -> DataFrame:
    """edges(u, v) to (node, root): every node of an edge with the smallest node it is connected to.

    Self-loops are ignored; no edges give no rows.  Ends when a round changes nothing, which the sum of
    the edges' hashes and their number tell.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = work.keep(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    seen = mark(now)
    while True:
        new = work.keep(small_star(large_star(now)))
        work.drop(now)
        now, last, seen = new, seen, mark(new)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
