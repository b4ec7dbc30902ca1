"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters, digits and non-ASCII bytes, or runs of ASCII
punctuation. Features are hashed words, word pairs, pairs of word shapes, and a
back-reference for a word that repeats the one before. A document is the mean of
its n-grams' unit vectors times SCALE; its score is a sparse dot product. Whole
texts are read; null and empty texts have no n-grams and get the score of the bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .textbuf import flat, hashes, mix, pair, runs, slices

BITS = 18
SCALE = 16.0
#: At most about so many labelled rows a class are learned from.
TRAIN_ROWS = 4000
THRESHOLD = 0.7

_CLASS = np.ones(256, np.uint8)
_CLASS[:0x80] = 2
_CLASS[[0x20, *range(0x09, 0x0E), 0x00]] = 0
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _CLASS[_a:_b] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[0x30:0x3A] = 1


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram numbers, and the bounds of each document's."""
    kind = _CLASS[data]
    starts, ends, first = runs(kind, off)
    n = len(starts)
    h = hashes(data, starts, ends)
    upper = _UPPER[data[starts]] + 2 * _UPPER[data[ends - 1]] if n else np.zeros(0, np.uint8)
    punct = kind[starts] == 2
    shape = np.where(punct, h | np.uint64(8), upper.astype(np.uint64) + np.uint64(4) * _DIGIT[data[starts]]) if n else h
    feats = np.empty((n, 4), np.int64)
    mask = np.uint64((1 << BITS) - 1)
    last = np.zeros(n, bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    nh, ns = np.roll(h, -1), np.roll(shape, -1)
    nh[last], ns[last] = 0, 0
    feats[:, 0] = (h & mask).astype(np.int64)
    again = nh == h
    feats[:, 1] = (np.where(again, np.where(punct, np.uint64(12345), np.uint64(54321)), pair(h, nh)) & mask).astype(np.int64)
    feats[:, 2] = (pair(shape, ns + np.uint64(77)) & mask).astype(np.int64)
    feats[:, 3] = (mix(shape + np.uint64(991)) & mask).astype(np.int64)
    return feats.ravel(), first * 4


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int, importance: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x * importance
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def example(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's sparse vector, bias last, from its n-gram numbers."""
    at, count = np.unique(f, return_counts=True)
    return np.append(at, 1 << BITS).astype(np.int32), np.append(count * (SCALE / max(1, len(f))), 1.0).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4) -> np.ndarray:
    """Weights from (places, values, label) rows; classes weigh the same in sum."""
    model = Ftrl()
    ones = sum(y for _, _, y in rows)
    weight = {1: len(rows) / (2 * max(1, ones)), 0: len(rows) / (2 * max(1, len(rows) - ones))}
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            model.update(at, x, y, min(weight[y], 20.0))
    return model.weights(slice(None)).astype(np.float32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: list[tuple[int, tuple[np.ndarray, np.ndarray], int]] = []
    share = tables.Share(tables.TRAIN_BYTES)
    for b in batches:
        b = b.filter(pa.array([share.fits(y, t) for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True)], pa.bool_()))
        data, off = flat(b.column("text"))
        ids, ys = b.column("doc_id").to_pylist(), b.column("y").to_pylist()
        for a, z in slices(off):
            f, first = ngrams(data[off[a] : off[z]], off[a : z + 1] - off[a])
            seen += [(ids[i], example(f[first[i - a] : first[i - a + 1]]), ys[i]) for i in range(a, z)]
    seen.sort(key=lambda r: (r[0], len(r[1][0])))
    w = fit([(*x, y) for _, x, y in seen]) if seen else np.zeros((1 << BITS) + 1, np.float32)
    del seen
    tables.release()
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from a bounded sample of the labelled documents outside fold `held`.

    The sample, at most about `most` documents and TRAIN_BYTES of text a class, is small enough for one task;
    only the weights (1 MB) reach the driver. What tables.labelled() says of nulls and repeats holds here.
    """
    sample = tables.labelled(docs, labels, label, tables.fold("doc_id", folds) != held, most)
    got = sample.mapInArrow(_train, "model binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def probabilities(weights: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The score of each document of a flat text column."""
    out = np.empty(len(off) - 1)
    for a, b in slices(off):
        f, first = ngrams(data[off[a] : off[b]], off[a : b + 1] - off[a])
        total = np.zeros(len(f) + 1)
        np.cumsum(weights[f], out=total[1:])
        n = np.diff(first)
        out[a:b] = SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` with a column quality_score; an earlier column of that name is replaced, all others stay."""
    shared = spark.sparkContext.broadcast(weights)
    return tables.append(docs, "quality_score double", lambda b: [pa.array(probabilities(shared.value, *flat(b.column("text"))))])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, held_out (null for a null id), score, predicted (1: good, from 0.7)."""
    docs = tables.read(spark, sf_dir, "documents")
    weights = train(docs, tables.read(spark, sf_dir, "labels"))
    s = F.col("quality_score")
    return score(spark, docs.select("doc_id", "text"), weights).select("doc_id", (tables.fold("doc_id", 4) == 2).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of `docs` whose text scores 0.7 or more, unchanged, whatever their other columns are called.

    Each row is judged by itself, so rows with null or equal ids and repeated rows stay or go by their text;
    null and empty texts have the score of the bias. An empty table gives an empty one.
    """
    weights = train(docs, tables.read(spark, sf_dir, "labels"))
    return tables.unpacked(score(spark, tables.packed(docs), weights).where(F.col("quality_score") >= THRESHOLD), docs)
