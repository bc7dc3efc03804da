"""Sinks: caches named by their settings, training records, vectors and statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def config_key(dataset: str, **flags: object) -> str:
    """The md5 name of an artefact: its dataset and its settings in the order of their names."""
    return hashlib.md5("|".join([dataset, *(f"{k}={str(v).lower()}" for k, v in sorted(flags.items()))]).encode()).hexdigest()


def cache_key(dataset: Column, name: Column, **flags: object) -> Column:
    """The same as a column, with one part that varies by row."""
    return F.md5(F.concat_ws("|", dataset, name, *[F.lit(f"{k}={str(v).lower()}") for k, v in sorted(flags.items())]))


def write_cache(df: DataFrame, folder: str, key: str, overwrite: bool = False) -> str:
    """Parquet under the key; what is there already stays unless ``overwrite``."""
    path = f"{folder.rstrip('/')}/{key}"
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)
    return path


def read_cache(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The cached frame, or None if there is none."""
    path = f"{folder.rstrip('/')}/{key}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines, one object a row: training pairs, hard negatives, statistics of pairs."""
    df.write.mode(mode).json(path)


def write_vectors(vectors: DataFrame, folder: str, dataset: str, **flags: object) -> str:
    """Embeddings (id, v) as Parquet under the key of the settings that made them."""
    return write_cache(vectors.select("id", "v"), folder, config_key(dataset, **flags), overwrite=True)
