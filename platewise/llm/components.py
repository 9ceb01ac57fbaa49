"""Connected components of a link table by alternating stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import shared


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link to another.

    A large-star round links every node's larger neighbours to its smallest neighbour, a small-star round does
    the same for the smaller ones; both keep components and shrink them to stars in O(log^2 n) rounds.  Minima are
    aggregated before the shuffle and a hub's links meet its one minimum in a join that Spark may split, so no
    node gathers its neighbours in one place.  Nulls and links to oneself are left out.
    """
    edges = shared(links.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star-0")
    seen = None
    turn = 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        turn += 1
        edges = shared(_small_star(_large_star(edges)), f"star-{turn}")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = edges.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
