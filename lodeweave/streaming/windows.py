"""Aggregates over streams, and a way to run a stream over all that is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint_dir


def windowed(stream: DataFrame, time: str, keys: list[str], width: str, late: str, **aggregates: Column) -> DataFrame:
    """(start, keys, aggregates) of tumbling windows; state of windows older than the watermark is dropped, and so are later rows."""
    rows = stream.withWatermark(time, late)
    out = rows.groupBy(F.window(time, width).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("_w.start").alias("start"), *keys, *aggregates)


def running_votes(stream: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """(start, q, c, n, first): votes of ballots (q, round, c) inside each window, and the first round that cast one."""
    return windowed(stream, time, ["q", "c"], width, late, n=F.count("*"), first=F.min("round"))


def run_available(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the stream over everything that is there now and gives its result from the shared folder.

    ``complete`` keeps the last state of all rows, ``append`` the rows that the watermark has closed.  Offsets and
    state lie in the shared folder too, so lost executors, or a driver that starts again, lose nothing.
    """
    spark = result.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "complete":

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/rows")

        query = result.writeStream.outputMode("complete").foreachBatch(write)
    else:
        query = result.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/rows")
    query.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/rows")
