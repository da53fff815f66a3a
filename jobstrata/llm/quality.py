"""Quality classifier: random Fourier features of document statistics, ridge from partition-summed normal equations,
isotonic calibration.

Statistics of a whole text (byte classes, word shapes, repetition) become a fixed vector; cosines of random projections
approximate a Gaussian kernel on it; each task adds its rows into one D x D matrix per fold, and the matrices are summed
in a tree. What reaches the driver has a fixed size whatever the number of rows. Each fold is scored by the model of the
other one; these scores, counted in bins, are calibrated by pooling adjacent violators."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata.llm.sums import SCHEMA, sum_rows, tree_sum
from jobstrata.llm.words import NOT_SPACE, Words, small_batches
from jobstrata.session import Stages

#: groups of bytes whose shares are statistics; the rest of ASCII is one more group
BYTE_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b"!", b"?", b".", b",;:", b"|", b"#$%&*", b"'\"()-", bytes(range(128, 256)))
_GROUP = np.full(256, len(BYTE_GROUPS), np.int64)
for _k, _members in enumerate(BYTE_GROUPS):
    _GROUP[list(_members)] = _k
N_STATS = len(BYTE_GROUPS) + 1 + 12

DIMENSIONS = 384
BANDWIDTH = 6.0
RIDGE = 1e-4
SEED = 11
BINS = 2048
TIE_SHARE = 1e-3


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATS numbers per text; an empty text has zeros."""
    n, k = len(offsets) - 1, len(BYTE_GROUPS) + 1
    size = np.diff(offsets).astype(float)
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    groups = np.bincount(doc_of_byte * k + _GROUP[data], minlength=n * k).reshape(n, k)
    w = Words(data, offsets, NOT_SPACE)
    doc, words = w.doc_of_word(), np.maximum(w.counts, 1).astype(float)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n) / words
    length = (w.end - w.start).astype(float)
    mean = per_doc(length)
    first, last = (_GROUP[data[w.start]], _GROUP[data[w.end - 1]]) if len(w.start) else (np.zeros(0), np.zeros(0))
    order = np.lexsort((w.hash, doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n)
    repeated = np.zeros(len(doc))
    repeated[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    more = [np.log1p(size), np.log1p(w.counts), mean, np.sqrt(np.maximum(per_doc(length ** 2) - mean ** 2, 0)), per_doc(length <= 3), per_doc(length >= 12), per_doc(first == 0),
            per_doc(np.isin(last, (5, 10))), per_doc(last == 7), np.log1p(distinct) / np.log1p(words), per_doc(repeated), np.log1p(size / (groups[:, 4] + 1))]
    return np.column_stack([groups / np.maximum(size, 1)[:, None], *more])


def _projection(dims: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(SEED)
    return rnd.normal(0, 1 / BANDWIDTH, (N_STATS, dims)), rnd.uniform(0, 2 * np.pi, dims)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, dims: int) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant."""
    w, b = _projection(dims)
    z = np.clip((x - mean) / scale, -8, 8)
    return np.column_stack([np.sqrt(2.0 / dims) * np.cos(z @ w + b), np.ones(len(x))])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray      # raw scores of the calibration's steps
    value: np.ndarray   # their calibrated scores
    dims: int

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = fourier(x, self.mean, self.scale, self.dims) @ self.weights
        return (1 - TIE_SHARE) * np.interp(raw, self.at, self.value) + TIE_SHARE * np.clip(raw, 0, 1)


def with_statistics(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    names = [c for c in docs.columns if c != text_col]

    def run(batches):
        for rows, data, offsets in small_batches(batches, text_col):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in names] + [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float64()))], names=names + [out])
    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def fit(training: DataFrame, dims: int = DIMENSIONS) -> Model:
    """Model from rows (x: statistics, y: share of label 1, fold: 0 or 1). Without rows every score is one half."""
    stages = Stages(training.sparkSession)
    rows = stages.keep(training.select("x", F.col("y").cast("double"), F.col("fold").cast("int")), "training")

    def moments(batches):
        total = np.zeros(2 * N_STATS + 1)
        for b in batches:
            x = _matrix(b, "x")
            total += np.concatenate([[len(x)], x.sum(0), (x ** 2).sum(0)])
        yield sum_rows({0: total})

    m = tree_sum(rows.select("x").mapInArrow(moments, SCHEMA), stages).get(0, np.zeros(2 * N_STATS + 1))
    if m[0] == 0:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(dims + 1), np.array([0.0]), np.array([0.5 / (1 - TIE_SHARE)]), dims)
    mean = m[1: N_STATS + 1] / m[0]
    scale = np.sqrt(np.maximum(m[N_STATS + 1:] / m[0] - mean ** 2, 1e-12))
    scale[scale < 1e-5] = 1.0

    def normal(batches):
        total = {0: np.zeros((dims + 1) * (dims + 2) + 1), 1: np.zeros((dims + 1) * (dims + 2) + 1)}
        for b in batches:
            z, y, fold = fourier(_matrix(b, "x"), mean, scale, dims), np.array(b.column("y")), np.array(b.column("fold"))
            for k in (0, 1):
                zk = z[fold == k]
                total[k] += np.concatenate([(zk.T @ zk).ravel(), zk.T @ y[fold == k], [len(zk)]])
        yield sum_rows(total)

    sums = tree_sum(rows.mapInArrow(normal, SCHEMA), stages)
    d = dims + 1

    def solve(s: np.ndarray) -> np.ndarray:
        penalty = RIDGE * max(s[-1], 1.0) * np.eye(d)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(s[:d * d].reshape(d, d) + penalty, s[d * d: d * d + d])

    by_fold, weights = [solve(sums[1]), solve(sums[0])], solve(sums[0] + sums[1])

    def binned(batches):
        n, y = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            z, fold = fourier(_matrix(b, "x"), mean, scale, dims), np.array(b.column("fold"))
            raw = np.where(fold == 0, z @ by_fold[0], z @ by_fold[1])
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            y += np.bincount(at, weights=np.array(b.column("y")), minlength=BINS)
        yield sum_rows({0: np.concatenate([n, y])})

    counts = tree_sum(rows.mapInArrow(binned, SCHEMA), stages)[0]
    stages.drop(rows)
    at, value = isotonic(counts[:BINS], counts[BINS:])
    return Model(mean, scale, weights, at, value, dims)


def isotonic(n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators over counted bins; centre and value of each pooled block."""
    blocks: list[list[float]] = []  # rows, sum of labels, sum of centres
    for i in np.flatnonzero(n):
        blocks.append([n[i], y[i], n[i] * ((i + 0.5) / len(n) * 2 - 0.5)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics and labels of the rows to learn from: crc32(id) mod 3 is not 1; the two other remainders are the folds.

    Several labels of one id are averaged; null labels and ids teach nothing."""
    rest = F.crc32(F.col("id").cast("string")) % 3
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y")).where(rest != 1)
    x = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", "x")
    return x.join(known, "id").select("x", "y", F.when(rest == 0, 0).otherwise(1).alias("fold"))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "_q_score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text; null and empty texts are scored as empty."""
    m, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for rows, data, offsets in small_batches(batches, text_col):
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in names] + [pa.array(m.value.score(statistics(data, offsets)))], names=names + [out])
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Repeated rows get equal scores; a null id is not held out."""
    model = fit(training_rows(docs, labels, id_col, text_col))
    s = score(docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_text")), model, "_q_text")
    held = F.coalesce(F.crc32(F.col("_q_id").cast("string")) % 3 == 1, F.lit(False))
    return s.select(F.col("_q_id").alias(id_col), held.alias("held_out"), F.col("_q_score").alias("score"), (F.col("_q_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that the classifier does not reject, with the columns of docs."""
    model = fit(training_rows(docs, labels, id_col, text_col))
    return score(docs, model, text_col).where("_q_score >= 0.5").select(*[f"`{c}`" for c in docs.columns])
