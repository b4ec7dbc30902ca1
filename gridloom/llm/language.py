"""Language identification by error-correcting output codes.

Each language has a codeword; one logistic classifier a bit predicts it from
hashed byte trigrams. Decoding takes the codeword with the least sum of
logistic losses, each bit weighted by how well it was learned, and flags close calls.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .textbuf import flat, slices

DIM = 4096
#: At most about so many documents a language, and in all about so many, are learned from; with more languages than that, about so many of them.
TRAIN_ROWS, TRAIN_TOTAL = 1500, 12000
#: Documents whose two best codewords differ by less than this share of probability are ambiguous.
CLOSE = 0.2
#: Documents whose histograms are held at once.
ROWS = 1024

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x61:0x7B] = _ASCII_LETTER[0x41:0x5B] = True


def histograms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The L2-normalised square roots of each document's trigram counts, n x DIM."""
    d = _FOLD[data]
    out = np.zeros((len(off) - 1, DIM), np.float32)
    if len(d) >= 3:
        x = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA6B)) ^ (d[2:] * np.uint32(0xC2B2AE35))
        x = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        for i in range(len(off) - 1):
            if off[i + 1] - off[i] >= 3:
                out[i] = np.bincount(x[off[i] : off[i + 1] - 2], minlength=DIM)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of -1 / 1, far apart: all dichotomies for few languages, else the best of some random ones without constant columns."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far, tries = None, -1, min(200, 2 * 10**9 // (n * n * bits) + 1)
    while best is None or tries > 0:
        tries -= 1
        m = rng.choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(m.sum(axis=0)) == n).any():
            continue
        gap = (bits - _closest(m)) / 2
        if gap > far:
            best, far = m, gap
    return best


def _closest(m: np.ndarray) -> float:
    """The largest product of two different rows, some rows at a time, so that no square of all rows is held."""
    most = -np.inf
    for a in range(0, len(m), 512):
        products = m[a : a + 512] @ m.T
        products[np.arange(len(products)), a + np.arange(len(products))] = -np.inf
        most = max(most, float(products.max()))
    return most


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 150) -> dict:
    """Codewords, weights (DIM + 1 x bits) and bit weights by accelerated gradient descent."""
    code = codewords(len(names))
    t = code[y]
    balance = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y][:, None].astype(np.float32)
    w = v = np.zeros((DIM, code.shape[1]), np.float32)
    b = np.zeros(code.shape[1])
    for k in range(rounds):
        m = (x @ v + b) * t
        g = -t * balance / (1 + np.exp(np.clip(m, -30, 30))) / len(y)
        new = v - 40.0 * (x.T @ g.astype(np.float32) + 1e-5 * v)
        b = b - 2.0 * g.sum(axis=0)
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    right = ((x @ w + b) * t > 0).mean(axis=0)
    return {"names": names, "code": code, "w": w, "b": b, "trust": np.maximum(right - 0.5, 0.01) * 2}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword's number, its probability, and whether the runner-up is close."""
    f = x @ model["w"] + model["b"]
    n = len(model["names"])
    if n == 1:
        return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
    loss = np.stack([(model["trust"] * np.logaddexp(0, -f * c)).sum(axis=1) for c in model["code"]], axis=1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    top = np.sort(p, axis=1)
    return loss.argmin(axis=1), top[:, -1], top[:, -1] - top[:, -2] < CLOSE


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, names, xs = [], [], []
    share = tables.Share(tables.TRAIN_BYTES)
    for b in batches:
        b = b.filter(pa.array([share.fits(None, t) for t in b.column("text").to_pylist()], pa.bool_()))
        data, off = flat(b.column("text"))
        for a, z in slices(off, rows=ROWS):
            xs.append(histograms(data[off[a] : off[z]], off[a : z + 1] - off[a]))
        ids += b.column("doc_id").to_pylist()
        names += b.column("lang").to_pylist()
    model = None
    if ids:
        order = np.argsort(np.array(ids), kind="stable")
        known = sorted(set(names))
        model = fit(np.concatenate(xs)[order], np.array([known.index(v) for v in names])[order], known)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs: DataFrame, folds: int = 5, held: int = 0) -> dict | None:
    """A model from a bounded sample of the documents outside fold `held`; None without any.

    Rows with a null id, text or lang are not learned from; of several rows with one id and lang, that with
    the least text is. At most TRAIN_ROWS a language, TRAIN_TOTAL and TRAIN_BYTES in all; only these meet in one task.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (tables.fold("doc_id", folds) != held)).select("doc_id", "text", "lang")
    sample = tables.together(tables.bounded(known, "lang", "doc_id", TRAIN_ROWS, TRAIN_TOTAL), "lang")
    got = sample.mapInArrow(_train, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def identify(spark: SparkSession, docs: DataFrame, model: dict | None) -> DataFrame:
    """`docs` with lang_pred, lang_score (0 to 1) and lang_ambiguous; earlier columns of these names are replaced.

    Null texts, texts without a letter, and all texts if nothing could be learned: `und`, 0, true.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        model, text = shared.value, b.column("text")
        data, off = flat(text)
        names, score, close = [], np.zeros(len(text)), np.ones(len(text), bool)
        total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        lettered = total[off[1:]] > total[off[:-1]]
        for i in np.flatnonzero(~lettered & (off[1:] > off[:-1])):
            lettered[i] = any(c.isalpha() for c in text[int(i)].as_py())
        if model is None:
            lettered[:] = False
        for a, z in slices(off, rows=ROWS):
            ok = lettered[a:z]
            if ok.any():
                k, score[a:z], close[a:z] = decode(model, histograms(data[off[a] : off[z]], off[a : z + 1] - off[a]))
                names += [model["names"][j] if good else "und" for j, good in zip(k, ok, strict=True)]
            else:
                names += ["und"] * (z - a)
        score[~lettered], close[~lettered] = 0.0, True
        return [pa.array(names, pa.string()), pa.array(score), pa.array(close)]

    return tables.append(docs, "lang_pred string, lang_score double, lang_ambiguous boolean", run)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, held_out (null for a null id), lang_pred, score, ambiguous."""
    docs = tables.read(spark, sf_dir, "documents")
    out = identify(spark, docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (tables.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
