"""Mixing sources to target token counts by entropy balancing.

Among all rates r with sum(r * size) = target in each source and r <= ceiling, the
ones closest to 1 in relative entropy are r = min(ceiling, exp(lambda * size / scale));
lambda solves the convex dual.  Newton steps, kept inside a bracket, run on all
sources at once: each step is one aggregation over the (source, size) histogram,
which is all that the dual needs to know of the documents.  The rates are then
rounded into whole copies; inside blocks of a source the rounding error is carried
from larger documents to smaller ones, so every block comes out near its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) for (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` of all sizes; none gets over ``ceiling`` times its size, and what is over
    goes to the others by weight: target = min(ceiling * size, level * weight), where
    the level is found by passing the sources in order of ceiling * size / weight.
    One row a source; the windows run over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", ceiling * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", share * F.sum("source_size").over(every))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    # the first source that is not filled sets the level for the rest
    s = s.withColumn("try", F.when(F.col("cap") >= F.col("left") / F.col("open") * F.col("w"), F.col("left") / F.col("open")))
    first = F.first("try", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", first)
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def tilts(histogram: DataFrame, goals: DataFrame, ceiling: float = 2.0, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """(source, tilt, scale): lambda of each source for (source, size, n) and (source, source_size, target).

    A source whose target is its ceiling gets a null tilt: all its rates are the ceiling.
    Raises if ``max_steps`` don't bring every source within ``tolerance`` of its target.
    """
    base = histogram.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = goals.join(base, goals["source"].eqNullSafe(base["source"])).select(goals["source"], "target", "scale", F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (F.col("target") >= ceiling * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(False).alias("done"))
    state = materialize(state.where("target > 0"))
    rows = histogram.where("size > 0").select(F.col("source").alias("s"), "size", "n")
    for _ in range(max_steps):
        z = F.col("x") * F.col("size") / F.col("scale")
        rate = F.least(F.lit(ceiling), F.exp(F.least(z, F.lit(50.0))))
        slope = F.when(rate < ceiling, rate * F.col("size") / F.col("scale")).otherwise(0.0)
        live = state.where("not full and not done")
        got = rows.join(live, rows["s"].eqNullSafe(live["source"])).groupBy("s").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        new = state.join(got, state["source"].eqNullSafe(got["s"]), "left")
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("x")).otherwise(F.col("lo"))
        hi = F.when(miss >= 0, F.col("x")).otherwise(F.col("hi"))
        new = new.withColumn("miss", miss).withColumn("lo", lo).withColumn("hi", hi)
        step = F.col("x") - F.col("miss") / F.col("slope")
        inside = (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi"))) & (F.abs(step - F.col("x")) <= 4 * (1 + F.abs("x")))
        fallback = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("done") | (F.abs("miss") <= tolerance * F.col("target"))
        x = F.when(F.col("full") | F.col("s").isNull() | done, F.col("x")).when((F.col("slope") > 0) & inside, step).otherwise(fallback)
        state = materialize(new.select("source", "target", "scale", x.alias("x"), "lo", "hi", "full", F.coalesce(done, F.lit(False)).alias("done")))
        if state.where("not full and not done").isEmpty():
            break
    else:
        raise RuntimeError(f"rates did not settle in {max_steps} steps")
    return state.select("source", F.when(~F.col("full"), F.col("x")).alias("tilt"), "scale")


def _round_block(block: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for one block: the error of larger documents is carried to smaller ones."""
    block = block.sort_values(["size", "_id", "_h"], ascending=False, na_position="last")
    owed, copies = 0.0, []
    for n, r, top in zip(block["size"], block["rate"], block["top"], strict=True):
        low = int(np.floor(r))
        owed += (r - low) * n
        up = n > 0 and low < top and owed >= n / 2
        owed -= n * up
        copies.append(low + int(up))
    return block.assign(copies=copies)[["_id", "source", "size", "rate", "copies", "_h"]]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0, block_rows: int = 1000) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, rate, copies, taken, text_key.

    size is the number of words of the text (null: 0); taken = copies * size.  copies is
    floor(rate) or one more and never over the ceiling.  Rows without words get rate and
    copies 1.  A null source is a source of its own.  The result depends on the rows'
    values only; equal rows are interchangeable.  An empty table gives no rows; columns
    other than the three named are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("_h"))
    rows = materialize(rows)
    histogram = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    sizes = materialize(sizes)
    goals = materialize(targets(sizes.select("source", "source_size"), weights, share, ceiling))
    tilt = tilts(histogram, goals, ceiling)
    per = goals.join(sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = per.join(tilt.select(F.col("source").alias("s"), "tilt", "scale"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "_s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), ceiling).otherwise(F.least(F.lit(ceiling), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    per = materialize(per)
    rated = rows.join(per, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    block = F.pmod(F.xxhash64("_id", "_h"), F.ceil(F.col("rows") / block_rows)).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    inner = rated.select("_id", "source", "size", "rate", "_h", block.alias("_block"), F.lit(int(ceiling)).alias("top"))
    rounded = inner.groupBy("source", "_block").applyInPandas(_round_block, f"_id {kind}, source string, size long, rate double, copies int, _h long")
    out = rounded.join(per.select("_s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "rate", F.col("copies").cast("long"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("_h").alias("text_key"))
