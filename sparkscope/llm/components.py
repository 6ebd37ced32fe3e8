"""Connected components of an edge table by alternating star contraction.

Each round is two aggregations with map-side combine and two equi joins; the
number of rounds is logarithmic in the longest path. No link, label or
component ever reaches the driver, only two sums that tell convergence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.session import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node long, component long): the smallest node reachable over ``edges`` (a long, b long).

    Only nodes that occur in an edge to another node are returned; callers
    coalesce the rest to themselves. Nulls and self-loops are dropped, repeated
    rows count once, an empty table gives an empty table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = materialise(pairs.where("u > v").distinct())
    state = _state(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        current = materialise(_small_star(_large_star(current)), replaces=current)
        following = _state(current)
        if following == state:
            break
        state = following
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("u"), "v").distinct()
    return current.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    moved = edges.join(least, F.col("u") == F.col("n")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
