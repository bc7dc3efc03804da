"""Connected components by large-star / small-star rounds, each cut by a checkpoint.

Only minima per node are aggregated (they combine before the shuffle) and only
equi-joins are used, so a node with very many neighbours is split by the
adaptive skew join.  No neighbour list is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node in a pair; component is the smallest node reachable.

    Nulls and loops are left out; repeated pairs are allowed; no pairs give no rows.
    Raises if ``max_rounds`` do not settle (each round about halves the depth).
    """
    a, b = pairs[a], pairs[b]
    edges = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null and u <> v").select("u", "v").distinct())
    for _ in range(max_rounds):
        # settled: every node has one edge down at most, and no smaller node has one
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("x").agg(F.sum("down").alias("d"), F.max("up").alias("p")).where("d > 1 or (d = 1 and p = 1)").isEmpty():
            break
        # large star: all larger neighbours of a node go to its minimum
        low = _both(edges).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(_both(edges).where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
