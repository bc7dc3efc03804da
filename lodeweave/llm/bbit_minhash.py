"""b-bit MinHash near-duplicate detection.

1. One pass makes, per text, its distinct word shingles, ``bands * rows`` minima,
   one 64-bit key per band and the low ``BITS`` bits of every minimum, packed.
2. Texts with equal shingle sets fall together on a 128-bit fingerprint of the set
   (aggregated before the shuffle, so a group of copies is one row from here on).
3. Band keys give buckets.  A bucket is not paired out: every member meets one hub,
   the member whose buckets hold most rows in all (an unchanged original, as a rule), so
   at most ``bands`` pairs a class.  The packed bits of both sides give a
   collision-corrected similarity, and only what comes near the threshold is confirmed
   on the full sets.
4. Confirmed links become components.  Only members of a bucket that are still in
   different components can hold more links.  Buckets of at most PAIRED rows compare
   them by their packed bits, inside the join.  In larger ones a shingle is rare if at
   most RARE of their sets hold it.  Two sets either share a rare shingle (an equi-join
   of at most RARE rows a key) or have only their other shingles in common, whose count
   bounds the intersection exactly; rows that can reach the threshold with nobody go
   before the join.  So no candidate is lost, no group is paired out and nothing is
   confirmed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, grams, materialize, mix, seeds, slices
from .components import connected_components

BITS = 4
PER_LONG = 64 // BITS
#: Members of a bucket that are compared pair by pair; larger buckets go by their rare shingles.
PAIRED = 32
#: A shingle is rare if it stands in at most so many sets of large buckets.
RARE = 16


class Signer:
    """Sets and signatures of texts; one per task."""

    def __init__(self, shingle: int, bands: int, rows: int):
        self.shingle, self.bands, self.rows = shingle, bands, rows
        self.hasher = WordHasher()
        n = bands * rows
        self.flip, self.mul = seeds(n, 21)[:, None], seeds(n, 22)[:, None]
        self.band_seed = seeds(bands, 23)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text, in order."""
        k = self.shingle
        for i, j, data, ends in slices(column):
            words, at = self.hasher(data, ends)
            g = grams(words, k)
            for r in range(j - i):
                a, b = at[r], at[r + 1]
                if b - a >= k:
                    s = np.sort(g[a : b - k + 1])
                    if len(s) > 1:
                        s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                    yield s
                elif b > a:
                    own = mix(np.array([len(words[a:b])], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    for w in words[a:b]:
                        own = mix(own * np.uint64(0xD6E8FEB86659FD93) + w)
                    yield own
                else:
                    yield np.zeros(0, np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        out = None
        for a in range(0, len(s), 2048):
            m = ((s[None, a : a + 2048] ^ self.flip) * self.mul).min(axis=1)
            out = m if out is None else np.minimum(out, m)
        return out

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = mix(self.minima(s))
        by_band = m.reshape(self.bands, self.rows)
        key = self.band_seed.copy()
        for r in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + by_band[:, r])
        low = (m & np.uint64((1 << BITS) - 1)).reshape(-1, PER_LONG)
        packed = np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1)
        return key.view(np.int64), packed.view(np.int64)


SALT = seeds(2, 31)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, whatever its order."""
    if not len(s):
        return 0, 0
    return int(np.add.reduce(mix(s * SALT[0])).view(np.int64)), int(np.add.reduce(mix(s ^ SALT[1])).view(np.int64))


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, f1, f2, keys, packed) for the columns (id, text)."""
    if bands * rows % PER_LONG:
        raise ValueError(f"bands * rows must be a multiple of {PER_LONG}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shingle, bands, rows)
        for batch in batches:
            n, f1, f2, keys, packed = [], [], [], [], []
            for s in signer.sets(batch.column(1)):
                n.append(len(s))
                x, y = fingerprint(s)
                f1.append(x)
                f2.append(y)
                k, p = signer.sign(s) if len(s) else (None, None)
                keys.append(k)
                packed.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "f1", "f2", "keys", "packed"],
            )

    return docs.mapInArrow(work, "id long, n_shingles long, f1 long, f2 long, keys array<long>, packed array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, f1, f2, hashes): the full sets, 8 bytes a shingle, sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shingle, 4, 4)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = list(signer.sets(part.column(1)))
                prints = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "f1", "f2", "hashes"])

    return docs.mapInArrow(work, "id long, f1 long, f2 long, hashes binary")


def estimate(x: Column, y: Column, longs: int) -> Column:
    """Similarity from packed signatures: the share of equal b-bit values, freed of chance hits."""
    ones = F.lit(int("1" * PER_LONG, 16))
    differ = F.lit(0)
    for i in range(longs):
        d = x[i].bitwiseXOR(y[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        differ = differ + F.bit_count(d.bitwiseAND(ones))
    chance = 1 / (1 << BITS)
    equal = 1 - differ / F.lit(float(longs * PER_LONG))
    return (equal - chance) / (1 - chance)


def _similar(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                hit = np.searchsorted(y, x)
                hit[hit == len(y)] = 0
                both = int(np.count_nonzero(y[hit] == x)) if len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, margin: float = 0.2) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    A text's set is its distinct shingles of lower-cased (A-Z) words; fewer words make
    one shingle of all of them; no words or a null text make an empty set, linked with
    nothing.  Rows are linked when 100 * intersection >= percent * union; component_id
    is the smallest id reachable (a row's own, if none).  Rows that repeat an id with
    another text join what either text is linked with.  A null id stays in the result
    with a null component_id and kept true, and links nothing.  Other columns are not read.
    The band keys miss a link at the threshold with probability
    (1 - 0.8 ** 4) ** 24 = 3e-6, the estimate (standard error 0.04) with less.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(own, shingle, bands, rows))
    full = signed.where("n_shingles > 0 and id is not null")
    classes = materialize(full.groupBy("f1", "f2", "n_shingles").agg(F.min_by(F.struct("id", "keys", "packed"), "id").alias("s")).select("f1", "f2", "n_shingles", "s.*"))
    member = full.select("id", "f1", "f2").join(classes.select("f1", "f2", F.col("id").alias("rep")), ["f1", "f2"]).select("id", "rep").distinct()
    member = materialize(member.where("id <> rep"))
    links = _class_links(docs.sparkSession, own, classes, shingle, percent, bands, rows, margin)
    links = links.unionByName(member.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    component = materialize(connected_components(links))
    out = signed.select("id", "n_shingles").join(component.withColumnRenamed("node", "id"), "id", "left")
    out = out.withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingle) for every element of (id, hashes)."""
    for batch in batches:
        for k in range(batch.num_rows):
            own = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[k].as_py(), np.int64)), pa.array(own)], names=["id", "shingle"])


def _class_links(spark, own, classes, shingle, percent, bands, rows, margin) -> DataFrame:
    """Pairs of class ids that span the components of all links."""
    longs = bands * rows // PER_LONG
    member = classes.select("id", F.explode("keys").alias("key"))
    member = materialize(member.join(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    central = member.groupBy("id").agg(F.sum("n").alias("score"))
    hub = member.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("score", F.xxhash64("id"), "id")).alias("hub"))
    sig = classes.select("id", "n_shingles", "packed")

    def near(x: str, y: str, n: str, m: str) -> Column:
        """Whether a pair may reach the threshold by its sizes and packed bits."""
        sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
        return sizes & (estimate(F.col(x), F.col(y), longs) >= percent / 100 - margin)

    hubs = member.join(hub, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    x = hubs.join(sig.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("packed").alias("pa")), "a")
    y = x.join(sig.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("packed").alias("pb")), "b")
    found = materialize(y.where(near("pa", "pb", "na", "nb")).select("a", "b"))

    # a class's representative is one of the rows of its id: the one whose set has its fingerprint
    first = own.where("id is not null")

    def full_sets(ids: DataFrame) -> DataFrame:
        texts = first.join(ids, "id", "left_semi")
        made = shingle_sets(texts, shingle).join(classes.select("id", "f1", "f2"), ["id", "f1", "f2"], "left_semi")
        return materialize(made.select("id", "hashes").dropDuplicates(["id"]))

    sets = full_sets(found.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = confirm(found, sets, percent)
    label = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("c"))

    # members of a bucket that no hub has brought together: the pairs between components
    part = materialize(member.join(label, "id", "left").select("key", "id", "n", F.coalesce("c", "id").alias("c")))
    apart = part.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    part = materialize(part.join(apart, "key").join(sig, "id"))

    def other(rows: DataFrame, on: str) -> DataFrame:
        return rows.select(F.col(on).alias("_on"), F.col("id").alias("i"), F.col("c").alias("d"), F.col("n_shingles").alias("m"), F.col("packed").alias("p"), *[F.col(c).alias(f"{c}_") for c in rows.columns if c in ("common", "keys")])

    def between(rows: DataFrame, on: str, also: Column | None = None) -> DataFrame:
        test = (F.col(on) == F.col("_on")) & (F.col("id") < F.col("i")) & (F.col("c") != F.col("d")) & near("packed", "p", "n_shingles", "m")
        both = rows.join(other(rows, on), test if also is None else test & also)
        return both.select(F.col("id").alias("a"), F.col("i").alias("b"))

    # large buckets: a pair shares a rare shingle, or its other shingles alone must reach the threshold
    large = part.where(F.col("n") > PAIRED)
    open_ids = large.select("id", "c", "n_shingles", "packed").distinct()
    large_sets = full_sets(large.select("id").distinct())
    posting = materialize(large_sets.mapInArrow(_postings, "id long, shingle long"))
    rare = posting.join(posting.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= RARE), "shingle")
    rare = materialize(rare)
    common = rare.groupBy("id").agg(F.count("*").alias("u"))
    large = large.join(common, "id", "left").withColumn("common", F.col("n_shingles") - F.coalesce("u", F.lit(0)))
    least = large.groupBy("key").agg(F.min("n_shingles").alias("least"))
    need = (100 + percent) * F.col("common") >= percent * (F.col("n_shingles") + F.col("least"))
    large = large.join(least, "key").where(need).join(classes.select("id", "keys"), "id")
    large = materialize(large.select("key", "id", "c", "n_shingles", "packed", "common", "keys"))
    enough = (100 + percent) * F.least("common", "common_") >= percent * (F.col("n_shingles") + F.col("m"))
    enough = enough & (F.array_intersect("keys", "keys_")[0] == F.col("key"))  # once, in the first bucket of both
    sharing = rare.where("df > 1").join(open_ids, "id")
    rest = between(part.where(F.col("n") <= PAIRED), "key").unionByName(between(large, "key", enough)).unionByName(between(sharing, "shingle"))
    rest = materialize(rest.distinct().join(found, ["a", "b"], "left_anti"))
    more = rest.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id"), "id", "left_anti")
    sets = sets.unionByName(full_sets(more))
    stars = label.where("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b"))
    return stars.unionByName(confirm(rest, sets, percent))
