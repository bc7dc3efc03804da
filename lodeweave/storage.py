"""Where intermediate results are kept: the folder that all machines of the session share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder in local mode if it is unset, an error on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lodeweave-"))
    return sc.getCheckpointDir()


#: Spark's switch that deletes a query's shuffle files as soon as the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame) -> DataFrame:
    """The frame from a reliable checkpoint, so that nothing before it runs again and lost executors lose no results; its plan's shuffle files go with the plan."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the switch
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
