"""Benchmark decontamination: pigeonhole edit matching on words.

An item of m words may differ from a stretch of a document by k = floor(m * error)
word edits (a change, loss or gain of a word).  The item is cut into k + 1 pieces,
so at least one piece stands unchanged in every such stretch.  Piece hits are
found by hash and each is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, grams, materialize, slices, text_buffers

#: Words are runs of ASCII letters and digits and all other UTF-8 bytes; ASCII case is folded.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]
    budgets: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # words a piece -> sorted hashes, item, place

    @staticmethod
    def build(rows: list[tuple[int, str | None]], error: float, min_words: int) -> Items:
        hasher = WordHasher(SEPARATORS)
        raw, at = text_buffers(pa.array([t for _, t in rows], pa.string()))
        flat, ends = hasher(raw[at[0] : at[-1]], at - at[0])
        ids, words, budgets, found = [], [], [], {}
        for r, (i, _) in enumerate(rows):
            w = flat[ends[r] : ends[r + 1]].copy()
            if i is None or len(w) < min_words:
                continue
            k = int(len(w) * error)
            cuts = np.linspace(0, len(w), k + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found.setdefault(int(b - a), []).append((int(grams(w[a:b], int(b - a))[0]), len(ids), int(a)))
            ids.append(i)
            words.append(w)
            budgets.append(k)
        pieces = {}
        for n, rows_ in found.items():
            rows_.sort()
            pieces[n] = (np.array([x[0] for x in rows_], np.uint64), np.array([x[1] for x in rows_]), np.array([x[2] for x in rows_]))
        return Items(ids, words, budgets, pieces)


def myers(masks: dict[int, int], m: int, stretch: list[int]) -> tuple[int, int]:
    """(least distance of the pattern to any part of the stretch, place of that part's last word)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, where = m, -1
    for j, w in enumerate(stretch):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score < best:
            best, where = score, j
    return best, where


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error: float = 0.2, min_words: int = 5, block_items: int = 5000, max_item_bytes: int = 32 << 20) -> DataFrame:
    """(id_col, item_id, distance, n_item_words, start_word, end_word) for each document and item that match.

    One row a pair, with the nearest stretch (ties: the first; end is exclusive).  Items of
    fewer than ``min_words`` words, null items and null texts match nothing; a null item id
    is left out; rows that repeat a document's id give rows of their own.  The items are
    taken in blocks of ``block_items``; a block over ``max_item_bytes`` is halved,
    so what is broadcast is bounded whatever the benchmark's size; the corpus is scanned once a
    block.  Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["b"] // (max_item_bytes // 2)))
    if blocks > 1:
        items = materialize(items)
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        rows = sorted((r["i"], r["t"]) for r in part.collect())
        one = _search(own, spark.sparkContext.broadcast((rows, error, min_words)), kind)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def _search(own: DataFrame, shared, kind: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.build(*shared.value)
        masks: dict[int, dict[int, int]] = {}
        hasher = WordHasher(SEPARATORS)
        bits = np.uint64(64 - 22)
        sieve = {}
        for n, (hashes, _, _) in items.pieces.items():
            sieve[n] = np.zeros(1 << 22, bool)
            sieve[n][hashes >> bits] = True
        for batch in batches:
            found = []
            for i, j, data, ends in slices(batch.column(1)):
                words, at = hasher(data, ends)
                near: dict[tuple[int, int], list[int]] = {}
                for n, (hashes, item, place) in items.pieces.items():
                    g = grams(words, n)
                    spots = np.flatnonzero(sieve[n][g >> bits])
                    lo = np.searchsorted(hashes, g[spots], "left")
                    hi = np.searchsorted(hashes, g[spots], "right")
                    some = hi > lo
                    for p, a, b in zip(spots[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                        doc = int(np.searchsorted(at, p, "right")) - 1
                        if p + n > at[doc + 1]:
                            continue
                        for q in range(a, b):
                            near.setdefault((doc, int(item[q])), []).append(p - int(place[q]))
                for (doc, q), starts in near.items():
                    k, m = items.budgets[q], len(items.words[q])
                    mask = masks.get(q)
                    if mask is None:
                        mask = masks[q] = _masks(items.words[q])
                    best = None
                    spans: list[list[int]] = []
                    for s in sorted(set(starts)):  # stretches that overlap are one, so each word is read once
                        a, b = max(int(at[doc]), s - k), min(int(at[doc + 1]), s + m + k)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    for a, b in spans:
                        d, last = myers(mask, m, words[a:b].tolist())
                        if d <= k and (best is None or d < best[0]):
                            stop = a + last + 1
                            back = myers(_masks(items.words[q][::-1]), m, words[max(a, stop - m - k) : stop][::-1].tolist())
                            best = (d, stop - back[1] - 1 - int(at[doc]), stop - int(at[doc]))
                    if best is not None:
                        found.append((i + doc, items.ids[q], best[0], m, best[1], best[2]))
            found.sort(key=lambda x: x[:2])
            cols = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "item_id", "distance", "n_item_words", "start_word", "end_word"])

    return own.mapInArrow(work, f"id {kind}, item_id long, distance long, n_item_words long, start_word long, end_word long")
