"""What the operators of this subpackage share: checkpoints, text keys and vectorised word hashing.

The numpy helpers work straight on Arrow buffers, so no Python string is made
for a document.  Memory is bounded by ``SLICE_BYTES`` (or one document).
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts are runs of anything but these code points.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 18
#: Which bytes are ASCII letters and digits.
ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one only in local mode (tests), else an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lodeweave-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's switch that deletes a query's shuffle files as soon as the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Nothing reads the shuffle files of its plan again, so they go with it, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the switch
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage, so that checkpoints which nothing refers to can go (where Spark is set to delete them).

    Python's comes first: its frames hold the driver's.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def let(value: Column, then) -> Column:
    """then(value) with the value computed once a row: a lambda binds it.

    A column that is used inside another lambda would be computed for every element.
    """
    return F.transform(F.array(value), then)[0]


def sealed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns named by their place (c0, c1, ...), so no added name can clash, and those names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def opened(df: DataFrame, of: DataFrame, names: list[str], added: dict[str, Column | str]) -> DataFrame:
    """The columns of ``of`` under their own names, then the added ones, which replace columns of their names.

    The added ones are computed before any column has its own name back, so no name can be taken for another.
    """
    made = [(F.col(c) if isinstance(c, str) else c).alias(f"added{i}") for i, c in enumerate(added.values())]
    kept = [F.col(c).alias(n) for c, n in zip(names, of.columns, strict=True) if n not in added]
    return df.select(*names, *made).select(*kept, *[F.col(f"added{i}").alias(n) for i, n in enumerate(added)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- numpy side -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd, well spread 64-bit constants."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHasher:
    """Word hashes of many texts at once: a polynomial over the UTF-8 bytes, then a mixer.

    ``separators`` are byte values between words; A-Z fold to a-z if ``fold``.
    """

    def __init__(self, separators: bytes = b"\x20\x09\x0a\x0b\x0c\x0d", fold: bool = True):
        table = seeds(256, 7)
        if fold:
            table[65:91] = table[97:123]
        self.table = table
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.base = 0xD6E8FEB86659FD93
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(SLICE_BYTES + 1)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                step = np.uint64(pow(b, len(out), 1 << 64))
                out = np.concatenate([out, out * step])
            return out[:n]

        self.up, self.down = powers(self.base), powers(self.inverse)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of texts in a row; ends: n + 1 offsets. Gives word hashes and n + 1 word offsets."""
        words, start, _ = self.spans(data, ends)
        return words, np.searchsorted(start, ends) if len(data) else np.zeros(len(ends), np.int64)

    def spans(self, data: np.ndarray, ends: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first bytes and last bytes of all words; a byte of the table ``cut`` that ends a word after an ASCII letter or digit is a word of its own."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n >= len(self.up):
            self._grow(n + 1)
        word = self.is_word[data]
        first = np.empty(n, bool)
        first[0] = True
        np.logical_not(word[:-1], out=first[1:])
        inner = ends[(ends > 0) & (ends < n)]
        first[inner] = True
        first &= word
        last = np.empty(n, bool)
        last[-1] = True
        np.logical_not(word[1:], out=last[:-1])
        last[inner - 1] = True
        last &= word
        if cut is not None:
            at = np.flatnonzero(last & cut[data] & ~first)
            at = at[ALNUM[data[at - 1]]]
            first[at] = True
            last[at - 1] = True
        start, stop = np.flatnonzero(first), np.flatnonzero(last)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        return mix((sums[stop + 1] - sums[start]) * self.down[start]), start, stop


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n words (runs over text ends are the caller's to leave out)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    c = seeds(n, 11)
    out = words[: len(words) - n + 1] * c[0]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * c[k]
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of pieces of about ``limit`` bytes."""
    raw, at = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
