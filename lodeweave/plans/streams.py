"""Registered queries that run as streams over a table, with the SQL of their final results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import windows
from .catalog import query
from .fixtures import table


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    # the source wants a folder or a pattern; the class of one letter makes it a pattern
    rows = s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")
    # times without a zone are read as UTC, whatever the session's zone
    return rows.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))


@query("SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(s, d):
    out = windows.windowed(_stream(s, d, "events"), "ts", ["event_type"], "6 hours", "1 day", n=F.count("*"), total=F.sum("value"))
    return windows.run_available(out).withColumns({"start": F.unix_seconds("start"), "total": F.round("total", 4)})


@query("SELECT epoch(time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, user_id AS q, event_type AS c, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def stream_votes(s, d):
    ballots = _stream(s, d, "events").select("ts", F.col("user_id").alias("q"), F.col("event_id").alias("round"), F.col("event_type").alias("c"))
    return windows.run_available(windows.running_votes(ballots, "ts", "1 day", "24 hours")).withColumn("start", F.unix_seconds("start"))
