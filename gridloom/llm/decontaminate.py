"""Benchmark decontamination: an FM-index per shard of training documents, searched backwards for test phrases.

A shard is a run of documents of one task. Its symbols are the words that any
phrase holds; runs of other words are one separator, which no phrase can cross.
A shard is indexed once and all phrases are searched in it, a block of them at a
time; the rows found are located by sampled suffix positions, and overlapping
occurrences merge into removal spans. Nothing is shuffled. The benchmark is sent
to the tasks as word numbers; only one of more than SENT_BYTES takes further
rounds, each written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .fm_index import FmIndex
from .textbuf import flat, hashes, runs, slices, spread

WINDOW = 10
#: Text indexed at once, benchmark text of a block of phrases, and of all blocks sent to the tasks at once.
SHARD_BYTES, BLOCK_BYTES, SENT_BYTES = 4 << 20, 1 << 20, 32 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.zeros(256, np.uint8)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and each row's first word."""
    data, off = flat(column)
    data = _LOWER[data]
    return data, *runs(_WORD[data], off)


def _first_eight(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes(data, starts, np.minimum(ends, starts + 8))


@dataclass
class Block:
    """The distinct windows of some items: first word and length of each, and the items (by place) that hold it."""

    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray  # each window's first owner, and the end
    owners: np.ndarray


@dataclass
class Phrases:
    """Items as symbols (words from 2, numbered over all items at hand), and their windows in blocks."""

    vocabulary: np.ndarray
    heads: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    names: list[str | None]
    blocks: list[Block]

    @staticmethod
    def of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        data, starts, ends, first = words(pa.array([t for _, t in items], pa.large_string()))
        vocabulary, at, symbol = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        symbol = (symbol + 2).astype(np.int32)
        size = np.array([len((t or "").encode()) for _, t in items], np.int64)
        found = [_windows(symbol, first, a, b, window) for a, b in slices(np.concatenate([[0], np.cumsum(size)]), BLOCK_BYTES)]
        return Phrases(vocabulary, _first_eight(data, starts[at], ends[at]), (ends - starts)[at], symbol, [None if k is None else str(k) for k, _ in items], found)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The symbol of each word, 1 for one that no phrase holds."""
        h = hashes(data, starts, ends)
        if len(self.vocabulary) == 0:
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        same = (self.vocabulary[at] == h) & (self.lengths[at] == ends - starts)
        here = np.flatnonzero(same)
        same[here] = self.heads[at[here]] == _first_eight(data, starts[here], ends[here])
        return np.where(same, at + 2, 1)


def _windows(symbol: np.ndarray, first: np.ndarray, a: int, b: int, window: int) -> Block:
    """The distinct windows of items a to b."""
    n = np.diff(first[a : b + 1])
    size = np.minimum(n, window)
    count = np.where(n > 0, n - size + 1, 0)
    starts, sizes = spread(first[a:b], count), np.repeat(size, count)
    owner = np.repeat(np.arange(a, b), count)
    padded = np.append(symbol, np.zeros(window, np.int32))
    grid = np.where(np.arange(window)[None, :] < sizes[:, None], padded[starts[:, None] + np.arange(window)], 0)
    order = np.lexsort((owner, *grid.T[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = (grid[order[1:]] != grid[order[:-1]]).any(axis=1)
    pair = new.copy()
    pair[1:] |= owner[order[1:]] != owner[order[:-1]]
    head = order[new]
    return Block(starts[head], sizes[head], np.append(np.searchsorted(np.flatnonzero(pair), np.flatnonzero(new)), pair.sum()), owner[order[pair]])


def find(phrases: Phrases, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Each document's first word in the shard, a flag for each hit word, the words' starts, and the items found in each document."""
    data, starts, ends, first = words(column)
    symbol = phrases.number(data, starts, ends)
    n = len(first) - 1
    hit = np.zeros(len(symbol), bool)
    items: list[set[str]] = [set() for _ in range(n)]
    # separators between documents and for runs of other words: kept are phrase words and what begins a run of others
    opens = np.zeros(len(symbol), bool)
    opens[first[:-1][first[:-1] < len(symbol)]] = True
    known = symbol > 1
    keep = known | opens
    if len(symbol):
        keep[1:] |= known[:-1]
    place = np.flatnonzero(keep)
    if not known.any():
        return first, hit, starts, items
    break_before = np.flatnonzero(opens[place] & known[place])  # a document that begins with a phrase word
    text = np.insert(symbol[place], break_before, 1)
    place = np.insert(place, break_before, -1)
    # the shard's own numbers for the words that it holds; windows with other words can't occur
    held, text = np.unique(np.append(text, 1), return_inverse=True)
    own = np.zeros(len(phrases.vocabulary) + 2, np.int32)
    own[held] = np.arange(len(held)) + 1
    index = FmIndex(text[:-1] + 1, len(held) + 1)
    query = own[phrases.symbols]
    missing = np.concatenate([[0], np.cumsum(query == 0)])
    edge = np.zeros(len(hit) + 1, np.int64)
    for block in phrases.blocks:
        live = np.flatnonzero(missing[block.starts + block.sizes] == missing[block.starts])
        for size in np.unique(block.sizes[live]).tolist():
            mine = live[block.sizes[live] == size]
            lo, hi = index.search(query[block.starts[mine][:, None] + np.arange(size)].astype(np.int64))
            some = np.flatnonzero(hi > lo)
            count = hi[some] - lo[some]
            at = place[index.locate(spread(lo[some], count))]
            edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + size, minlength=len(edge))[: len(edge)]
            document = np.searchsorted(first, at, "right") - 1
            for d, w in np.unique(np.column_stack([document, np.repeat(mine[some], count)]), axis=0).tolist():
                items[d].update(x for k in block.owners[block.first[w] : block.first[w + 1]] if (x := phrases.names[k]) is not None)
    hit = np.cumsum(edge[: len(hit)]) > 0
    return first, hit, starts, items


def rounds(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items with their texts, about `most` characters at a time, none if there are none; one partition at a time reaches the driver."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


FIELDS = "n_words long, n_hit long, hit_words binary, hit_items array<string>"


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_hit, hit_words (a bit for each word, first word first) and hit_items (sorted ids).

    Null and empty texts have no words. An item without words hits nothing; items of one id count
    as one, items with a null id hit words but are not listed. Rows are searched one by one, so ids and
    repeats among them don't matter. Earlier columns of these names are replaced. A benchmark of
    more than SENT_BYTES takes several rounds; each but the last is kept in the shared folder, so
    neither the plan nor what is sent grows with it.
    """
    docs = docs.drop(*[f.split()[0] for f in FIELDS.split(", ")])
    held = None
    for items in rounds(benchmark, SENT_BYTES):
        if held is not None:
            docs = tables.checkpoint(docs)
        docs, held = _pass(spark, docs, Phrases.of(items, window), held is None), items
    return _pass(spark, docs, Phrases.of([], window), True) if held is None else docs


def _pass(spark: SparkSession, docs: DataFrame, phrases: Phrases, first: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(phrases)
    earlier = [] if first else [tables.fresh(docs, "earlier_words"), tables.fresh(docs, "earlier_items")]

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        text = b.column("text")
        n_words, n_hit, bits, items = [], [], [], []
        for x, y in slices(flat(text)[1], SHARD_BYTES):
            at, hit, _, found = find(shared.value, text[x:y])
            for k in range(y - x):
                own = hit[at[k] : at[k + 1]]
                ids = found[k]
                if earlier:
                    own = own | _flags(b.column(earlier[0])[x + k], len(own))
                    ids = ids | set(b.column(earlier[1])[x + k].as_py())
                n_words.append(len(own))
                n_hit.append(int(own.sum()))
                bits.append(np.packbits(own, bitorder="little").tobytes())
                items.append(sorted(ids))
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))]

    if first:
        return tables.append(docs, FIELDS, run)
    docs = docs.withColumnsRenamed(dict(zip(("hit_words", "hit_items"), earlier, strict=True)))
    return tables.append(docs, FIELDS, run).drop(*earlier)


def _flags(bits: pa.Scalar, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), bitorder="little")[:n].astype(bool)


def remove(docs: DataFrame) -> DataFrame:
    """`docs` as scan() returns them, with each span of hit words cut out of `text`; clean texts are untouched."""

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        out = b.column("text").to_pylist()
        for k, n in enumerate(b.column("n_hit").to_pylist()):
            if not n:
                continue
            raw = out[k].encode()
            _, starts, ends, _ = words(b.column("text")[k : k + 1])
            hit = _flags(b.column("hit_words")[k], len(starts))
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            kept, at = [], 0
            for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                kept.append(raw[at : starts[x]])
                at = ends[y - 1]
            out[k] = b"".join([*kept, raw[at:]]).decode()
        return [pa.array(out, pa.string())]

    return tables.append(docs, "cleaned string", run)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(spark, docs, tables.read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays; benchmark passages are cut from its text and n_chars follows, all else is unchanged, whatever it is called.

    Rows are searched one by one, so ids and repeats don't matter; null texts stay null, an empty table stays
    empty, and an empty benchmark changes nothing.
    """
    out = remove(scan(spark, tables.packed(docs), tables.read(spark, sf_dir, "benchmark")))
    n_chars = F.when(F.col("n_hit") > 0, F.length("cleaned")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None
    return tables.unpacked(out.withColumn("length", n_chars if n_chars is not None else F.lit(None)).withColumn("text", F.col("cleaned")), docs, F.col("length") if n_chars is not None else None)


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
o AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
m AS (SELECT o.k, o.i, o.n, p.item_id FROM o JOIN p ON o.n = p.n AND o.g = p.g),
h AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT k, i, n FROM m)) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.x, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.k = h.k LEFT JOIN t ON d.k = t.k
"""
