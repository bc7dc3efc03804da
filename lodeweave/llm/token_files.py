"""Token-ID output: documents to ids, ids to checksummed blocks, and back.

A shard is a range of ids of documents in order; a row of the file is a segment of
whole documents, whose ids are coded in blocks.  Python only tokenizes, and holds one
segment at a time; coding, decoding and checksums are JVM columns.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_codec
from .common import WordHasher, let, new_path, seeds, shuffle_partitions, slices

#: Ids after which a segment closes; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18
#: Bytes of texts that are tokenized together.
PART_BYTES = 1 << 18
#: Distinct pieces that a Python worker keeps over all its tasks; then the store is emptied.
KEPT_PIECES = 1 << 20
#: First bytes of the UTF-8 forms of white space beyond ASCII.
WIDE = (0xC2, 0xE1, 0xE2, 0xE3)


class PieceEncoder:
    """Ids of texts by a byte-level BPE tokenizer file, with the ids of pieces kept.

    A byte-level BPE splits a text before each single blank and around each single
    newline, whatever stands around, and before a mark such as a full stop after an ASCII
    letter or digit.  So a piece is a word with the blank before it, or its last mark;
    a newline is an id of its own.  Equal pieces have equal ids, and each distinct piece is tokenized once; all pieces
    of a part are looked up at once by 64-bit hashes.  Texts with any other white space, or
    with white space at an end or in a row, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.hasher = WordHasher(b" \n", fold=False)
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if len(self.newline) != 1:
            raise ValueError("a byte-level tokenizer has one id for a newline")
        self.after = seeds(3, 61)  # what stands before a word: nothing, a blank, a newline
        self.mark = np.zeros(256, bool)
        self.mark[list(b",.;:!?")] = True
        # 0 word, 1 blank or newline, 2 other ASCII white space and controls, 3 may begin wide white space
        self.kind = np.zeros(256, np.uint8)
        self.kind[:32] = 2
        self.kind[[0x20, 0x0A]] = 1
        self.kind[[0x3C, 0x7F]] = 2, 2
        self.kind[list(WIDE)] = 3
        self.lead = np.zeros(256, np.int64)
        self.lead[[0x20, 0x0A]] = 1, 2
        self._clear()

    def _clear(self) -> None:
        # an open hash table: key 0 is free, a key's place is that of its ids
        self.slot_key, self.slot_place = np.zeros(2 * KEPT_PIECES, np.uint64), np.zeros(2 * KEPT_PIECES, np.int32)
        self.n = 0
        self.starts, self.lens = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.n_ids, self.flat = 0, np.zeros(1 << 14, np.int32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place (-1 if unknown), and the slot where the search ended."""
        mask = np.uint64(len(self.slot_key) - 1)
        slot = (keys >> np.uint64(20) & mask).astype(np.int64)
        seen = self.slot_key.take(slot)
        place = np.where(seen == keys, self.slot_place.take(slot), -1)
        open_ = np.flatnonzero((seen != keys) & (seen != 0))
        while len(open_):
            at = (slot[open_] + 1) & int(mask)
            slot[open_] = at
            seen = self.slot_key.take(at)
            hit = seen == keys[open_]
            place[open_[hit]] = self.slot_place[at[hit]]
            open_ = open_[~hit & (seen != 0)]
        return place, slot

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Tokenizes new pieces; newlines between them mark their ends."""
        joined = [b"\n".join(pieces[i : i + 20]) + b"\n" for i in range(0, len(pieces), 20)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([j.decode(errors="replace") for j in joined], add_special_tokens=False)])
        stop = np.flatnonzero(ids == self.newline[0])
        lens = np.diff(np.concatenate(([-1], stop))) - 1
        if len(lens) != len(pieces):
            raise ValueError("pieces and ids don't match")
        ids = ids[ids != self.newline[0]]

        def put(old: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
            if n + len(new) > len(old):
                old = np.concatenate((old[:n], np.zeros(n // 2 + 2 * len(new), old.dtype)))
            old[n : n + len(new)] = new
            return old

        self.starts = put(self.starts, self.n, self.n_ids + np.concatenate(([0], np.cumsum(lens)[:-1])))
        self.lens = put(self.lens, self.n, lens)
        self.flat = put(self.flat, self.n_ids, ids)
        place = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n, self.n_ids = self.n + len(keys), self.n_ids + len(ids)
        while len(keys):  # of keys that want the same slot one gets it, the others look on
            slot = self._find(keys)[1]
            self.slot_key[slot] = keys
            self.slot_place[slot] = place
            lost = self.slot_key[slot] != keys
            keys, place = keys[lost], place[lost]

    def _pieces(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, stop: np.ndarray, lead: np.ndarray) -> np.ndarray:
        place, _ = self._find(keys)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            order = miss[np.argsort(keys[miss], kind="stable")]
            new = order[np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))]
            raw = data.tobytes()
            self._learn(keys[new], [raw[a - b : c] for a, b, c in zip(start[new].tolist(), (lead[new] == 1).tolist(), (stop[new] + 1).tolist(), strict=True)])
            place[miss] = self._find(keys[miss])[0]
        return place

    def _odd(self, data: np.ndarray, ends: np.ndarray, inner: bool = False) -> np.ndarray:
        """Which texts must go to the tokenizer whole; inner: the first byte is no text's first."""
        kind = self.kind[data]
        n = len(data)
        white = kind == 1
        bad = kind == 2
        less = np.flatnonzero(data == 0x3C)  # only "<|" begins a special token
        bad[less] = (less + 1 < n) & (data[np.minimum(less + 1, n - 1)] == 0x7C)
        bad[1:] |= white[1:] & white[:-1]
        full = ends[1:] > ends[:-1]
        edge = np.concatenate((ends[:-1][full][int(inner):], ends[1:][full] - 1))
        bad[edge] |= white[edge]
        wide = np.flatnonzero(kind == 3)
        if len(wide):
            a, b, c = data[wide], data[np.minimum(wide + 1, n - 1)], data[np.minimum(wide + 2, n - 1)]
            bad[wide] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            bad[wide] |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        sums = np.concatenate(([0], np.cumsum(bad)))
        return sums[ends[1:]] > sums[ends[:-1]]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one long text, taken in parts that begin at white space."""
        cuts = [0]
        while len(data) - cuts[-1] > 2 * PART_BYTES:
            near = cuts[-1] + PART_BYTES
            white = np.flatnonzero(self.kind[data[near : near + PART_BYTES]] == 1)
            if not len(white):
                return self._whole(data)
            cuts.append(near + int(white[0]))
        parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
        if any(self._odd(p, np.array([0, len(p)]), k > 0)[0] for k, p in enumerate(parts)):
            return self._whole(data)
        return np.concatenate([self.encode(p, np.array([0, len(p)]), k > 0)[0] for k, p in enumerate(parts)])

    def _whole(self, data: np.ndarray) -> np.ndarray:
        return np.array(self.tokenizer.encode(data.tobytes().decode(errors="replace"), add_special_tokens=False).ids, np.int32)

    def encode(self, data: np.ndarray, ends: np.ndarray, inner: bool = False) -> list[np.ndarray]:
        """The ids of each text, for the texts' bytes in a row and their n + 1 offsets; inner: see ``_odd``."""
        n = len(ends) - 1
        if n == 1 and len(data) > 2 * PART_BYTES:
            return [self._long(data)]
        if len(data) == 0:
            return [np.zeros(0, np.int32)] * n
        if self.n > KEPT_PIECES or self.n_ids > 8 * KEPT_PIECES:
            self._clear()
        odd = self._odd(data, ends, inner)
        words, start, stop = self.hasher.spans(data, ends, self.mark)
        at = np.searchsorted(start, ends)
        lead = self.lead[data[start - 1]]
        full = ends[:-1] < ends[1:]
        lead[np.searchsorted(start, ends[:-1][full & ~odd][int(inner):])] = 0  # such a text begins with a word
        if odd.any():
            regular = np.repeat(~odd, np.diff(at))
            lead[~regular] = 0
            words = np.where(regular, words, np.uint64(0))
        keys = words * self.after[lead] | np.uint64(1)
        take = np.flatnonzero(np.repeat(~odd, np.diff(at))) if odd.any() else slice(None)
        place = self._pieces(data, keys[take], start[take], stop[take], lead[take])
        new_line = lead[take] == 2
        lens = self.lens.take(place) + new_line
        upto = np.cumsum(lens, dtype=np.int64)
        begin = upto - lens
        ids = self.flat.take(np.arange(upto[-1] if len(upto) else 0, dtype=np.int64) + np.repeat(self.starts.take(place) - new_line - begin, lens), mode="clip")
        ids[begin[new_line]] = self.newline[0]
        n_words = np.where(odd, 0, np.diff(at))
        cut = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(n_words)))]
        return [self._whole(data[ends[i] : ends[i + 1]]) if odd[i] else ids[cut[i] : cut[i + 1]] for i in range(n)]


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    """A worker's encoder, kept from task to task."""
    return PieceEncoder(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, n_shards: int | None = None) -> None:
    """Code every text (null: empty) and its end id, in ascending order of id_col, nulls first.

    Rows that repeat an id follow each other by a hash of their text; equal rows are
    interchangeable.  An empty table makes files without rows.  Other columns are not
    read.  A text of any length is one segment at most; its ids must fit in 2 GB.
    """
    n_shards = n_shards or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange(n_shards, "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_path)
        ids: list = []
        parts: list[np.ndarray] = []
        size = number = 0

        def segment() -> pa.RecordBatch:
            flat = np.concatenate(parts).astype("<u4").tobytes()
            lens = [len(p) for p in parts[::2]]
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[n + 1 for n in lens]], pa.list_(pa.int64())), pa.array([flat], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "n_ids", "doc_ids", "lens", "ids"])

        end = np.array([end_id], np.int32)
        for batch in batches:
            for i, j, data, ends in slices(batch.column(1), PART_BYTES):
                for doc, tokens in zip(batch.column(0).slice(i, j - i).to_pylist(), encoder.encode(data, ends), strict=True):
                    if size and size + len(tokens) + 1 > SEGMENT_IDS:
                        yield segment()
                        ids, parts, size, number = [], [], 0, number + 1
                    ids.append(doc)
                    parts += (tokens, end)
                    size += len(tokens) + 1
        if ids:
            yield segment()

    made = rows.mapInArrow(work, "shard int, segment int, n_ids long, doc_ids array<long>, lens array<long>, ids binary")
    made.select("shard", "segment", "n_ids", "doc_ids", "lens", token_codec.encode("ids").alias("blocks")).write.parquet(path)


def read(spark, path: str, id_name: str = "doc_id") -> DataFrame:
    """(id_name, start, n_tokens, ids_crc32) of every document, decoded from the files; no documents give no rows.

    start counts the ids of all documents before; sums run per shard and over shards,
    from the segments' counts alone.  A damaged block, or a count that doesn't match, is an error.
    """
    files = spark.read.parquet(path)

    def documents(ids):
        # a document's first id is the sum of the lengths before it; each list is walked once
        starts = F.aggregate(
            "lens",
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
        )["out"]
        whole = F.when(F.length(ids) == 4 * F.col("n_ids"), ids).otherwise(F.raise_error(F.lit("a segment's count doesn't match its blocks")))
        one = lambda b, x: F.struct(x["doc_ids"].alias("id"), x["at"].alias("inner"), x["lens"].alias("n_tokens"), F.crc32(F.substring(b, (4 * x["at"] + 1).cast("int"), (4 * x["lens"]).cast("int"))).alias("ids_crc32"))
        return let(whole, lambda b: F.transform(F.arrays_zip("doc_ids", "lens", starts.alias("at")), lambda x: one(b, x)))

    docs = files.select("shard", "segment", F.explode(let(token_codec.decode("blocks"), documents)).alias("d")).select("shard", "segment", "d.*")
    counts = files.select("shard", "segment", "n_ids")
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    shards = shards.withColumn("base", F.sum("all").over(Window.orderBy("shard")) - F.col("all")).select("shard", "base")
    inner = Window.partitionBy("shard").orderBy("segment")
    first = counts.withColumn("first", F.sum("n_ids").over(inner) - F.col("n_ids")).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("first")).alias("first"))
    out = docs.join(first, ["shard", "segment"])
    return out.select(F.col("id").alias(id_name), (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write the documents' ids below the shared folder and give what the files hold."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, id_col, text_col, end_id)
    return read(docs.sparkSession, path, id_col)
