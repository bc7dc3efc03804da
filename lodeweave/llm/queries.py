"""The registered queries of the ten operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bbit_minhash, decontaminate, entropy_mix, hash_tree, language_id, pii_bootstrap, quality_rules, quote_linking, substring_dedup, token_files
from .common import read_table

N_SHARDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.line_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_left_words", "depleted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op3_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.link(read_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "reply_to", "thread", "depth", "n_quoted_lines", "clean_text")


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hash_tree.even_tree(N_SHARDS)
    out = hash_tree.assign(read_table(spark, sf_dir, "documents"), tree, tree.grow("region0", "rack0", N_SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out), "text", "lang")
    out = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(out, model).select("doc_id", "held_out", "lang_pred", "score")


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.extract(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    def of(k: int):  # not a default of the lambda: F.filter would take that for a second parameter, the place in the array
        return lambda x: x["k"] == k

    count = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii_bootstrap.KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *count, F.sha2(pii_bootstrap.describe(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii_bootstrap.describe(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_substring_dedup, op3_quote_linking, op4_hash_tree, op5_language_id, op6_pii_bootstrap, op7_entropy_mix, op8_decontaminate, op9_token_coder, op10_bbit_minhash)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be told whole in SQL (hash functions, iterations, codecs); tests/llm holds brute-force versions."""
    return {}
