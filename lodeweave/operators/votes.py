"""Summaries of votes for pairs of neighbours, a row an entity, without the pairs: ids in order of the names, lists of ids for edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling

#: A key of more voters and partners than this is a hub: its partners are read once, not once a voter.
HUB = 512
#: Partners of all keys, 4 bytes each, that are sent to every worker; more go to the voters in shuffled lists.
SHARED = 1 << 26
SCHEMA = "n long, partners long, votes long, most long, best long"


def _summary(base: np.ndarray, order: np.ndarray, more: np.ndarray) -> tuple[int, int, int, int]:
    """(partners, votes, most, best) of the votes ``more`` (ids, repeated) beside a base: its ids in order, and for each its votes; ``order`` has the base's places, most votes first, then least id."""
    ids, votes = base
    got, n = np.unique(more, return_counts=True)
    best = None
    if len(got):
        both = n.copy()
        if len(ids):
            at = np.minimum(np.searchsorted(ids, got), len(ids) - 1)
            inside = ids[at] == got
            both[inside] += votes[at[inside]]
        k = int(np.argmax(both))
        best = (-int(both[k]), int(got[k]))
    extra = len(got)
    if len(ids):
        extra -= int(inside.sum()) if len(got) else 0
        taken = set(at[inside].tolist()) if len(got) else ()
        for place in order:  # ends after as many places as there are votes of the entity's own
            if int(place) not in taken:
                other = (-int(votes[place]), int(ids[place]))
                best = other if best is None or other < best else best
                break
    return len(ids) + extra, int(votes.sum()) + len(more), -best[0], best[1]


def summaries(voters: DataFrame, partners: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(n, partners, votes, most, best) for voters (n, key) and partners (key, m): each voter votes for all partners of its keys.

    A voter's row has its keys and counts their partners, which are sent to all workers once; if they are more
    than SHARED, the row gets lists of them, 4 bytes a vote.  Hubs, keys
    whose votes would grow with the square of their size, are told apart: voters with the same hubs
    share one count of the hubs' partners, and only what their other keys add is counted for each.
    """
    lists = save(partners.groupBy("key").agg(F.array_sort(F.collect_list(F.col("m").cast("int"))).alias("ms")))
    held = voters.groupBy("key").agg(F.count("*").alias("voters")).where(F.col("voters") > HUB)
    hubs = save(lists.join(held, "key").where(F.size("ms") > HUB).select("key", "ms"))
    voters = save(voters.select("n", "key"))
    count = lists.agg(F.coalesce(F.sum(F.size("ms")), F.lit(0))).first()[0]
    if count <= SHARED:
        found = lists.where(F.size("ms") > 0).toArrow()
        order = np.argsort(found.column("key").to_numpy(), kind="stable")
        at = np.append(0, np.cumsum(pc.list_value_length(found.column("ms")).to_numpy()))
        all_of = lists.sparkSession.sparkContext.broadcast((found.column("key").to_numpy()[order], at[order], at[order + 1], np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in found.column("ms").chunks]])))
        del found
        told = voters.join(F.broadcast(hubs.select("key", F.lit(True).alias("hub"))), "key", "left")
        rows = told.groupBy("n").agg(F.collect_list(F.when(F.col("hub").isNull(), F.col("key"))).alias("lists"), F.array_sort(F.collect_list(F.when(F.col("hub"), F.col("key")))).alias("hubs"))

        def partners_of(own: pa.Array) -> np.ndarray:
            keys, starts, ends, ms = all_of.value
            own = own.to_numpy() if len(keys) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            at = at[keys[at] == own]
            return np.concatenate([np.zeros(0, np.int32), *[ms[starts[k] : ends[k]] for k in at]])
    else:
        signed = voters.join(F.broadcast(hubs.select("key")), "key").groupBy("n").agg(F.array_sort(F.collect_list("key")).alias("hubs"))
        plain = voters.join(F.broadcast(hubs.select("key")), "key", "left_anti").join(lists, "key").select("n", "ms")
        rows = plain.groupBy("n").agg(F.collect_list("ms").alias("lists")).join(signed, "n", "full").select("n", "lists", F.coalesce("hubs", F.array().cast("array<long>")).alias("hubs"))

        def partners_of(own: pa.Array) -> np.ndarray:
            return own.flatten().to_numpy()

    shared = hubs.sparkSession.sparkContext.broadcast({r["key"]: np.array(r["ms"], np.int32) for r in hubs.toLocalIterator()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            out, kept = [], []
            for r in range(batch.num_rows):
                own = batch.column(1)[r].values
                more = partners_of(own) if own is not None and len(own) else np.zeros(0, np.int32)
                key = tuple(batch.column(2)[r].values.to_pylist())
                if not key and not len(more):
                    continue
                kept.append(r)
                if key not in known:
                    if len(known) > 64:
                        known.clear()
                    base = np.unique(np.concatenate([shared.value[k] for k in key]), return_counts=True) if key else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                    known[key] = base, np.lexsort((base[0], -base[1]))
                out.append(_summary(*known[key], more))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], names=["n", "partners", "votes", "most", "best"])

    return rows.select("n", "lists", "hubs").sortWithinPartitions("hubs").mapInArrow(work, SCHEMA)


def _named(voters: DataFrame, partners: DataFrame, voter: str, partner: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(voter, partners, votes, most, best) of voters (voter, key) and partners (partner, key); partners are numbered in order of their names, so that the least id is the first name."""
    names = save(sampling.numbered(partners.select(partner).distinct(), [partner]).select(partner, F.col("k").cast("long").alias("m")))
    ids = save(voters.select(voter).distinct().withColumn("n", F.monotonically_increasing_id()))
    out = summaries(voters.join(ids, voter).select("n", "key"), partners.join(names, partner).select("key", "m"), save)
    return out.join(ids, "n").join(names.select(F.col("m").alias("best"), F.col(partner).alias("_best")), "best").select(voter, "partners", "votes", "most", F.col("_best").alias("best"))


def structural(anchors: DataFrame, left: DataFrame, right: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The summary (n1, ..) of ``transport.structural_votes``."""
    keys = save(anchors.select("e1", "e2").withColumn("key", F.monotonically_increasing_id()))
    voters = left.select(F.col("a").alias("e1"), F.col("b").alias("n1")).join(keys.select("e1", "key"), "e1").select("n1", "key")
    partners = right.select(F.col("a").alias("e2"), F.col("b").alias("n2")).join(keys.select("e2", "key"), "e2").select("n2", "key")
    return _named(voters, partners, "n1", "n2", save)


def relational(anchors: DataFrame, pairs: DataFrame, left: DataFrame, right: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The summary (t1, ..) of ``transport.relation_votes``; pairs (r1, r2) are few."""
    keys = save(anchors.select("e1", "e2").withColumn("key", F.monotonically_increasing_id()))
    found = [tuple(r) for r in pairs.select("r1", "r2").collect()]
    few = F.broadcast(anchors.sparkSession.createDataFrame([(a, b, k) for k, (a, b) in enumerate(found)], "r1 string, r2 string, pair long"))
    key = (F.col("key") * max(1, len(found)) + F.col("pair")).alias("key")
    voters = left.select(F.col("head").alias("e1"), F.col("rel").alias("r1"), F.col("tail").alias("t1")).join(few.select("r1", "pair"), "r1").join(keys.select("e1", "key"), "e1").select("t1", key)
    partners = right.select(F.col("head").alias("e2"), F.col("rel").alias("r2"), F.col("tail").alias("t2")).join(few.select("r2", "pair"), "r2").join(keys.select("e2", "key"), "e2").select("t2", key)
    return _named(voters, partners, "t1", "t2", save)
