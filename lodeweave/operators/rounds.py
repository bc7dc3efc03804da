"""The pool of entities that are reranked in rounds, as tables.

A pool is (q, state, n): state is open, uncertain, aligned or killed, n the failures so
far.  ``aligned`` is (q, c).  A round takes all open entities at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, UNCERTAIN, ALIGNED, KILLED = "open", "uncertain", "aligned", "killed"


def start(queries: DataFrame) -> DataFrame:
    return queries.select("q").distinct().select("q", F.lit(OPEN).alias("state"), F.lit(0).alias("n"))


def step(pool: DataFrame, votes: DataFrame, max_uncertain: int) -> DataFrame:
    """The pool after a round whose accepted answers are votes (q, c); a first failure never kills."""
    hit = votes.select("q", F.lit(True).alias("ok")).distinct()
    p = pool.join(hit, "q", "left")
    tried, ok = F.col("state") == OPEN, F.coalesce("ok", F.lit(False))
    more = F.col("n") + 1
    state = F.when(~tried, F.col("state")).when(ok, ALIGNED).when((F.col("n") > 0) & (more >= max_uncertain), KILLED).otherwise(UNCERTAIN)
    return p.select("q", state.alias("state"), F.when(tried & ~ok, more).otherwise(F.col("n")).alias("n"))


def fuse(pool: DataFrame) -> DataFrame:
    """Uncertain entities are open again."""
    return pool.withColumn("state", F.when(F.col("state") == UNCERTAIN, OPEN).otherwise(F.col("state")))


def statistics(pool: DataFrame) -> DataFrame:
    return pool.groupBy("state").agg(F.count("*").alias("entities"))


def open_candidates(ranked: DataFrame, pool: DataFrame, aligned: DataFrame, filtered: bool = True) -> DataFrame:
    """Candidates of the open entities, without those that are aligned already if ``filtered``."""
    out = ranked.join(pool.where(F.col("state") == OPEN).select("q"), "q", "left_semi")
    return out.join(aligned.select("c").distinct(), "c", "left_anti") if filtered else out


def majority(ballots: DataFrame, rounds: int) -> DataFrame:
    """(q, c, n): the candidate with most ballots (q, round, c), the first cast if equal; over half of the rounds must agree."""
    n = ballots.where("c is not null").groupBy("q", "c").agg(F.count("*").alias("n"), F.min("round").alias("first"))
    best = n.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "first"))).where("k = 1")
    return (best.where(F.col("n") > rounds // 2) if rounds > 1 else best).select("q", "c", "n")


def run(ranked: DataFrame, ask: Callable[[DataFrame, int], DataFrame], rounds: int, max_uncertain: int, save: Callable[[DataFrame], DataFrame], filtered: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pool and aligned pairs after ``rounds``; ask(candidates, round) gives accepted answers (q, c), save cuts a frame's lineage.

    A candidate that two entities ask for in one round goes to the first of them.
    """
    pool = save(start(ranked))
    aligned = ranked.select("q", "c").limit(0)
    for k in range(rounds):
        votes = ask(open_candidates(ranked, pool, aligned, filtered), k).select("q", "c")
        if filtered:
            votes = votes.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("q"))).where("k = 1").drop("k")
        votes = save(votes)
        pool = save(fuse(step(pool, votes, max_uncertain)))
        aligned = save(aligned.unionByName(votes))
    return pool, aligned
