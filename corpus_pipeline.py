"""The corpus pipeline: five stages over documents, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import bbit_minhash, decontaminate, entropy_mix, language_id, token_files
from lodeweave.llm.common import new_path, read_table
from lodeweave.llm.queries import tokenizer_path

#: A document goes if its language has no letter to judge by or less than this score.
MIN_SCORE = 0.5


def _row_id(docs: DataFrame) -> DataFrame:
    """docs with _row, which equal (doc_id, text) share and others don't, nulls included."""
    return docs.withColumn("_row", F.xxhash64("doc_id", F.xxhash64("text"), F.col("text").isNull()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones.

    Null texts, empty ones and those without a letter go; so do all if no row has a label.
    Repeated rows stay; an empty table stays empty.
    """
    if docs.where("lang is not null and text is not null").isEmpty():
        return docs.limit(0)
    model = language_id.fit(docs, "text", "lang")
    kept = language_id.predict(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one with the smallest id, null ids last.

    Decisions are on rows (id and text), so a repeated id with another text is judged by its own text, and of
    equal rows one stays.  Texts without words are linked with nothing and stay; an empty table stays empty.
    """
    rows = _row_id(docs)
    found = bbit_minhash.near_duplicates(rows.select("_row", "text"), id_col="_row").select("_row", "component_id")
    ids = rows.select("_row", "doc_id").join(found.distinct(), "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row")).alias("k"))
    return rows.join(first.select("k._row"), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is judged by its own text, null ids too.  An empty benchmark drops none."""
    rows = _row_id(docs)
    hits = decontaminate.find(rows, read_table(spark, sf_dir, "benchmark"), id_col="_row").select("_row").distinct()
    return rows.join(hits, "_row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents of 0 copies go.

    Equal rows are one row here (the stage before leaves no others); null ids and sources are values like any other.
    """
    mixed = entropy_mix.mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_key").alias("_h")).agg(F.max("copies").alias("_copies"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    out = keyed.join(mixed, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_key") == F.col("_h")))
    return out.where("_copies > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32; a null text is an empty one, a document's copies follow each other."""
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_files", write_tokens),
]

#: SQL has no naive Bayes, MinHash or tokenizer; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
