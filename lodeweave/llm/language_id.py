"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to ``order``-grams of a bounded sample of labelled texts;
the smoothed log-probability matrix (buckets x languages) is broadcast; scoring
multiplies the sparse n-gram rows of each text with it in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, seeds

UNKNOWN = "und"
#: Code points handled at once; a text of more is scored in pieces that overlap by order - 1.
PIECE = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # (languages, buckets), float32
    log_prior: np.ndarray
    order: int


def _buckets(points: np.ndarray, order: int, n_buckets: int) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each place, for n from 1 to order."""
    shift = np.uint64(64 - int(n_buckets).bit_length() + 1)
    p = points.astype(np.uint64)
    c = seeds(order, 41)
    out, h = [], None
    for n in range(1, order + 1):
        part = p[n - 1 :] * c[n - 1]
        h = part if h is None else h[: len(part)] + part
        out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _groups(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of about PIECE code points in all."""
    i, n, group, size = 0, len(column), [], 0
    for j in range(n):
        t = column[j].as_py() or ""
        if group and size + len(t) > PIECE:
            yield i, j, group
            i, group, size = j, [], 0
        group.append(t)
        size += len(t)
    if group:
        yield i, n, group


def fit(labelled: DataFrame, text_col: str, lang_col: str, per_language: int = 3000, order: int = 3, n_buckets: int = 1 << 16, alpha: float = 0.1, max_languages: int = 1000) -> LanguageModel:
    """Learn from about ``per_language`` texts of each language (all, if there are fewer).

    The bound holds in expectation: a row is taken if a hash of its text falls under
    per_language / rows of its language, so the sample does not depend on row order
    or partitioning.  Rows with a null label or text are left out.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} labels")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, n_buckets), np.float32), np.zeros(0), order)
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, lang in enumerate(langs):
                text = batch.column(0)[i].as_py()
                k = index[lang]
                for a in range(0, max(1, len(text)), PIECE):
                    points = _points(text[a : a + PIECE])
                    if len(points):
                        row = total.setdefault(k, np.zeros(n_buckets, np.int64))
                        for b in _buckets(points, order, n_buckets):
                            row += np.bincount(b, minlength=n_buckets)
        for k, row in total.items():
            hit = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k), pa.int32()), pa.array(hit, pa.int32()), pa.array(row[hit], pa.int64())], names=["k", "bucket", "n"])

    counts = rows.where(draw < rate[F.col("lang")]).mapInArrow(count, "k int, bucket int, n long")
    table = counts.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
    matrix = np.full((len(languages), n_buckets), alpha)
    matrix[table.column("k").to_numpy(), table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    log_prob = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, log_prob, np.zeros(len(languages)), order)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input's columns with lang_pred and score (these two replace columns of the same names).

    lang_pred is ``und`` with score 0 for a null text, one without a letter, or a model
    without languages.  score is the posterior of the mean log-likelihood ratio
    over at most 64 n-grams' worth of evidence, so it stays comparable between lengths.
    Ties go to the first language in code-point order.
    """
    n_buckets = model.log_prob.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            pred, best = [], []
            for _, _, texts in _groups(batch.column(at)):
                sums, size = np.zeros((k, len(texts))), np.zeros(len(texts))
                points = [_points(t) for t in texts]
                big = len(points) == 1 and len(points[0]) > 2 * PIECE
                if k and big:
                    p = points[0]
                    for a in range(0, len(p), PIECE):
                        for n, b in enumerate(_buckets(p[a : a + PIECE + m.order - 1], m.order, n_buckets), 1):
                            b = b[: max(0, min(PIECE, len(p) - n + 1 - a))]
                            sums[:, 0] += [float(row[b].sum(dtype=np.float64)) for row in m.log_prob]
                            size[0] += len(b)
                elif k:
                    lens = np.array([len(p) for p in points])
                    ends = np.concatenate(([0], np.cumsum(lens)))
                    whole = np.concatenate(points) if points else np.zeros(0, np.uint32)
                    for n, b in enumerate(_buckets(whole, m.order, n_buckets), 1):
                        rows = np.flatnonzero(lens >= n)
                        if not len(rows):
                            continue
                        # alternate starts and stops; the odd pieces (n-grams over a text's end) are skipped
                        cut = np.stack([ends[rows], ends[rows + 1] - n + 1], axis=1).ravel()
                        tail = cut[-1] == len(b)
                        cut = cut[:-1] if tail else cut
                        for j, row in enumerate(m.log_prob):
                            got = row[b]
                            sums[j, rows] += np.add.reduceat(got, cut, dtype=np.float64)[::2]
                        size[rows] += lens[rows] - n + 1
                for i, t in enumerate(texts):
                    if not k or not any(map(str.isalpha, t)):
                        pred.append(UNKNOWN)
                        best.append(0.0)
                        continue
                    z = sums[:, i] / max(size[i], 1) * min(size[i], 64) + m.log_prior
                    j = int(np.argmax(z))
                    pred.append(m.languages[j])
                    best.append(float(1 / np.exp(z - z[j]).sum()))
            out = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*out, pa.array(pred, pa.string()), pa.array(best, pa.float64())], names=[*[x for i, x in enumerate(batch.schema.names) if i != at], "lang_pred", "score"])

    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.select(*[docs[c].alias(i) for c, i in zip(names, inner, strict=True)], docs[text_col].alias("_text"))
    kinds = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(names, inner, strict=True))
    out = rows.mapInArrow(score, f"{kinds}{', ' if kinds else ''}lang_pred string, score double")
    return out.select(*[F.col(i).alias(c) for c, i in zip(names, inner, strict=True)], "lang_pred", "score")
