"""Candidate sets, pairs as texts, and training records of retrievers and rerankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import hash_order


def gold_urls(gold: DataFrame, left: DataFrame, right: DataFrame, direction: str = "l2r") -> DataFrame:
    """(url1, url2) of gold pairs (q, gold) by id maps (id, url); r2l turns the pairs around."""
    if direction not in ("l2r", "r2l"):
        raise ValueError(f"unknown direction {direction}")
    pairs = gold.join(left.select(F.col("id").alias("q"), F.col("url").alias("a")), "q").join(right.select(F.col("id").alias("gold"), F.col("url").alias("b")), "gold")
    first, second = ("a", "b") if direction == "l2r" else ("b", "a")
    return pairs.select(F.col(first).alias("url1"), F.col(second).alias("url2"))


def pair_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(url1, url2, query, pos): both texts (url, text) of each pair; pairs that lack one go."""
    a, b = texts.select(F.col("url").alias("url1"), F.col("text").alias("query")), texts.select(F.col("url").alias("url2"), F.col("text").alias("pos"))
    return pairs.join(a, "url1").join(b, "url2").select("url1", "url2", "query", "pos")


def candidate_set(ranked: DataFrame, left: DataFrame, right: DataFrame, gold: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(url, candidate, score, rk, text, is_gold): the k best of each query with urls, texts (null if there is none) and gold."""
    top = ranked.where(F.col("rk") <= k).join(gold, "q", "left")
    out = top.join(left.select(F.col("id").alias("q"), "url"), "q").join(right.select(F.col("id").alias("c"), F.col("url").alias("candidate")), "c")
    out = out.join(texts.select(F.col("url").alias("candidate"), "text"), "candidate", "left")
    return out.select("url", "candidate", "score", F.col("rk").cast("bigint").alias("rk"), "text", F.coalesce(F.col("c") == F.col("gold"), F.lit(False)).alias("is_gold"))


def sft_pairs(pairs: DataFrame) -> DataFrame:
    """(query, pos, neg) records of training pairs with texts; the extra corpus stays a table of its own."""
    return pairs.select("query", F.array("pos").alias("pos"), F.array().cast("array<string>").alias("neg"))


def eval_pairs(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query, pos_id): the corpus (id, text) row of each query's only positive; not exactly one positive is an error."""
    one = F.when(F.size("pos") != 1, F.raise_error(F.lit("a query must have one positive"))).otherwise(F.get("pos", F.lit(0)))
    texts = corpus.groupBy(F.col("text").alias("p")).agg(F.min("id").alias("pos_id"))
    return pairs.select("query", one.alias("p")).join(texts, "p").select("query", "pos_id")


def top_up(negatives: DataFrame, corpus: DataFrame, n: int, exclude: DataFrame | None = None, seed: str = "7") -> DataFrame:
    """(q, c, filled): negatives (q, c) of each query, filled to n from the corpus (c) in a reproducible order.

    The corpus is drawn once: each query takes the first rows of one hash order that it does not hold yet,
    so only n + the most negatives of a query are looked at.  ``exclude`` (q, c) is never drawn.
    """
    have = negatives.select("q", "c").distinct()
    count = have.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") < n)
    barred = have if exclude is None else have.unionByName(exclude.select("q", "c")).distinct()
    most = barred.groupBy("q").count().agg(F.max("count")).first()[0] or 0
    drawn = [r[0] for r in corpus.select("c").distinct().orderBy(hash_order(seed, F.col("c")), "c").limit(n + most).collect()]
    places = F.posexplode(F.array(*map(F.lit, drawn)).cast(f"array<{corpus.schema['c'].dataType.simpleString()}>"))
    more = count.select("q", "n", places.alias("h", "c")).join(barred, ["q", "c"], "left_anti")
    more = more.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("h", "c"))).where(F.col("k") <= n - F.col("n"))
    return have.withColumn("filled", F.lit(False)).unionByName(more.select("q", "c", F.lit(True).alias("filled")))


def train_groups(negatives: DataFrame, size: int, seed: str = "7") -> DataFrame:
    """(q, c, place): size - 1 negatives (q, c) for each query, drawn by hash; too few are repeated in turn."""
    key = F.concat_ws("|", F.col("q").cast("string"), F.col("c").cast("string"))
    w = Window.partitionBy("q")
    rows = negatives.select("q", "c").distinct().withColumn("k", F.row_number().over(w.orderBy(hash_order(seed, key), "c"))).withColumn("n", F.count("*").over(w))
    places = F.when(F.col("k") <= size - 1, F.sequence(F.col("k"), F.lit(size - 1), F.col("n").cast("int")))
    return rows.select("q", "c", F.explode(places).alias("place"))
