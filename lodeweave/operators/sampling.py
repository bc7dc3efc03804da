"""Reproducible sampling: every draw is a hash of a seed and a key, so it needs no row order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import hash_order
from ..storage import save


def uniform(df: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def numbered(df: DataFrame, order: list, name: str = "k") -> DataFrame:
    """df with a gapless number from 1 in the given order, and _all rows in all.

    Rows are dealt out by ranges of the order and numbered inside each range, so no task holds the whole
    table; one count a range gives where it starts.  Ties of the order are numbered in any order.
    """
    dealt = save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(every).alias("_all"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_inner", inner).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_inner")).drop("_part", "_inner", "_start")


def first_share(df: DataFrame, keep: Callable[[Column], Column], order: list) -> DataFrame:
    """Rows with ``first``: whether their place in the order is at most keep(n) of n rows."""
    return numbered(df, order, "_k").withColumn("first", F.col("_k") <= keep(F.col("_all"))).drop("_k", "_all")


def weighted(df: DataFrame, group: str, key: Column, weight: Column, n: int, seed: str = "7") -> DataFrame:
    """n rows a group without replacement, by exponential keys -ln(u) / weight."""
    u = (hash_order(seed, key) + 0.5) / 4294967296.0
    draw = F.round(-F.ln(u) / weight, 8)
    return df.withColumn("draw", draw).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("draw", key))).where(F.col("_n") <= n).drop("_n")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str = "7") -> DataFrame:
    """floor(n * size / all) rows of each stratum."""
    size = df.groupBy(stratum).agg(F.count("*").alias("_m"))
    total = size.agg(F.sum("_m").alias("_all"))
    quota = size.join(F.broadcast(total)).select(stratum, F.floor(n * F.col("_m") / F.col("_all")).alias("_quota"))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)))
    return ranked.join(F.broadcast(quota), stratum).where("_n <= _quota").drop("_n", "_quota")


def reorder(ranked: DataFrame, how: str, seed: str = "7", position: int = 1) -> DataFrame:
    """(q, c, ..., ord) with ord from 1: shuffle, reverse, nope, or position (the row marked is_gold stands there)."""
    w = Window.partitionBy("q")
    if how == "shuffle":
        key = [hash_order(seed, F.concat(F.col("q").cast("string"), F.lit("|"), F.col("c").cast("string"))), F.col("c")]
    elif how == "reverse":
        key = [F.desc("rk")]
    elif how == "nope":
        key = [F.col("rk")]
    elif how == "position":
        rest = ranked.withColumn("_o", F.sum((~F.col("is_gold")).cast("int")).over(w.orderBy("rk")))
        at = F.when(F.col("is_gold"), F.lit(position) * 2 - 1).otherwise(F.col("_o") * 2)
        return rest.withColumn("ord", F.row_number().over(w.orderBy(at, "rk"))).drop("_o")
    else:
        raise ValueError(f"unknown order {how}")
    return ranked.withColumn("ord", F.row_number().over(w.orderBy(*key)))
