"""Substring dedup by super-k-mers.

Consecutive windows of a document that share a minimiser (the least hash among
their runs of MER words) travel together, as one piece of text, to the bin of
that minimiser. Documents are dealt into blocks of bounded size; a block sends
each distinct piece once to a bin, packed with all its pieces for that bin into
one compressed string. The bin sorts all windows by hash, compares equal hashes
by their words, and returns to each block the least document id of each window
that some document of the block must give up. The blocks then cut the words.

Minimisers that would fill a bin by themselves are found beforehand. Their windows, one piece each, go
to no bin: a partial minimum in each block and one aggregation give the least id of each, and blocks ask
for it by the window's digest, so neither a bin nor a key grows with a passage that most blocks hold.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .textbuf import WORDS, flat, gather, hashes, mix, pair, runs, slices, spread

WINDOW, MER = 13, 4
#: Most windows of a piece; bytes of text of a block, and of pieces in a bin, aimed at.
LONGEST, BLOCK_BYTES, BIN_BYTES = 64, 4 << 20, 12 << 20
#: Bytes of text dealt to the blocks at once.
DEAL_BYTES = 16 << 20
#: A minimiser with this share of a bin's pieces, as estimated from SEEN or more of them, is hot; hot ones are held as bits by hash.
HOT, SEEN, FEWEST_BITS, MOST_BITS, CHUNK_BITS = 1 / 4, 64, 10, 27, 18
#: Null ids count as this one.
LAST = np.iinfo(np.int64).max


def _shifted(f, x: np.ndarray, y: np.ndarray, by: int) -> np.ndarray:
    """f(x[i], y[i + by]); the ends that have no partner hold anything."""
    out = np.zeros_like(x)
    if len(x) > by:
        out[: len(x) - by] = f(x[: len(x) - by], y[by:])
    return out


def chains(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the MER = 4 and of the WINDOW = 13 words from each word on."""
    two = _shifted(pair, h, h, 1)
    four = _shifted(pair, two, two, 2)
    twelve = _shifted(pair, _shifted(pair, four, four, 4), four, 8)
    return four, _shifted(pair, twelve, h, 12)


def minimisers(four: np.ndarray) -> np.ndarray:
    """The least of the WINDOW - MER + 1 = 10 word runs in the window from each word on."""
    two = _shifted(np.minimum, four, four, 1)
    fours = _shifted(np.minimum, two, two, 2)
    eight = _shifted(np.minimum, fours, fours, 4)
    return _shifted(np.minimum, eight, two, 8)


@dataclass
class Cut:
    """Documents as words with single blanks, and their pieces; `uniques` in the order of (bin, hash)."""

    text: np.ndarray  # each word with a blank after it
    at: np.ndarray  # where each word begins, and the end
    first: np.ndarray  # each document's first word, and the end
    start: np.ndarray  # each piece's first word
    windows: np.ndarray  # and number of windows
    owner: np.ndarray  # and document
    number: np.ndarray  # and place in uniques
    uniques: np.ndarray  # a piece for each distinct one
    bins: np.ndarray  # the bin of each of uniques


def _slot(least: np.ndarray, bits: int) -> np.ndarray:
    return (mix(least) >> np.uint64(64 - bits)).astype(np.int64)


def _hot(least: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which minimisers are hot; `hot` has a bit for each slot, none if nothing is."""
    if len(hot) == 0:
        return np.zeros(len(least), bool)
    slot = _slot(least, (8 * len(hot)).bit_length() - 1)
    return (hot[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0


def _starts(four: np.ndarray, first: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows, document and minimiser of each piece."""
    count = np.maximum(np.diff(first) - WINDOW + 1, 0)
    window = spread(first[:-1], count)
    owner = np.repeat(np.arange(len(count)), count)
    least = minimisers(four)[window]
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    new |= _hot(least, hot)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(window)))
    parts = -(-length // LONGEST)
    begin = np.repeat(begin, parts) + spread(np.zeros(len(parts), np.int64), parts) * LONGEST
    length = np.diff(np.append(begin, len(window)))
    return window[begin], length, owner[begin], least[begin]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = flat(column)
    return data, *runs(WORDS[data], off)


def cut(column: pa.Array, bins: int, hot: np.ndarray) -> Cut:
    """Pieces with their bins; those of hot minimisers come last, as if in one bin more."""
    data, starts, ends, first = _words(column)
    text, at = gather(np.append(data, 0x20).astype(np.uint8), starts, ends + 1)
    text[at[1:] - 1] = 0x20
    four, whole = chains(hashes(data, starts, ends))
    start, windows, owner, least = _starts(four, first, hot)
    where = np.where(_hot(least, hot), bins, (mix(least) % np.uint64(bins)).astype(np.int64))
    if len(start) == 0:
        none = np.zeros(0, np.int64)
        return Cut(text, at, first, none, none, none, none, none, none)
    each = whole[spread(start, windows)]
    rel = spread(np.zeros(len(start), np.int64), windows).astype(np.uint64)
    at0 = np.cumsum(windows) - windows
    one = np.add.reduceat(mix(each + rel * np.uint64(0xD6E8FEB86659FD93)), at0)
    two = np.add.reduceat(mix((each ^ np.uint64(0xA0761D6478BD642F)) * (rel * np.uint64(2) + np.uint64(1))), at0)
    order = np.lexsort((two, one, where))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (where[order][1:] != where[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    uniques = order[new]
    return Cut(text, at, first, start, windows, owner, number, uniques, where[uniques])


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    head = struct.pack("<IQ", len(arrays[0]), len(raw))
    return head + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _spread_out(blob: bytes, *types: str) -> list[np.ndarray]:
    """Arrays of equal length of the types named, and what is left as bytes."""
    n, size = struct.unpack("<IQ", blob[:12])
    raw = pa.Codec("zstd").decompress(blob[12:], decompressed_size=size, asbytes=True)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return [*out, np.frombuffer(raw, np.uint8, -1, at) if at < len(raw) else np.zeros(0, np.uint8)]


def _deal(batch: pa.RecordBatch, blocks: int, repeats: tables.Repeats | None = None) -> pa.RecordBatch:
    """Rows (block, packed): the documents of a batch that go to each block, as lengths, ids, null ids and text.

    They are dealt by id and text; rows that have both in common, 32 at a time.
    """
    data, off = flat(batch.column("text"))
    null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(batch.column("doc_id"), LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = memoryview(data)
    own = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)), np.uint64, len(ids))
    keys = mix(ids.view(np.uint64) + null.astype(np.uint64)) + own
    block = (tables.shares(keys, repeats or tables.Repeats()) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    text, at = gather(data, off[:-1][order], off[1:][order])
    edges = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
    blobs = [_squeeze(np.diff(at[a : b + 1]).astype("<u8"), ids[order[a:b]], null[order[a:b]].astype("u1"), text[at[a] : at[b]]) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(block[order][edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "packed"])


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids, which of them are null, and texts of a block."""
    parts = [_spread_out(b, "<u8", "<i8", "u1") for b in table.column("packed").to_pylist()]
    size, ids, null, text = (np.concatenate([p[k] for p in parts]) for k in range(4))
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int64)
    return ids, null.astype(bool), pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(off), pa.py_buffer(text))


def _pieces(table: pa.Table, bins: int, hot: np.ndarray) -> tuple[Cut, np.ndarray, np.ndarray, int]:
    """A block's cut, the least and greatest id that holds each of its uniques, and how many of these are in bins."""
    ids, _, texts = _documents(table)
    c = cut(texts, bins, hot)
    least, most = np.full(len(c.uniques), LAST), np.full(len(c.uniques), np.iinfo(np.int64).min)
    np.minimum.at(least, c.number, ids[c.owner])
    np.maximum.at(most, c.number, ids[c.owner])
    return c, least, most, int(np.searchsorted(c.bins, bins))


def _send(table: pa.Table, bins: int, hot: np.ndarray) -> pa.Table:
    """Rows (bin, block, pieces) of a block: length in bytes, windows, least and greatest id, text."""
    c, least, most, n = _pieces(table, bins, hot)
    start, windows = c.start[c.uniques[:n]], c.windows[c.uniques[:n]]
    text, off = gather(c.text, c.at[start], c.at[start + windows + WINDOW - 1])
    edges = np.append(np.flatnonzero(np.diff(c.bins[:n], prepend=-1)), n)
    blobs = [_squeeze(np.diff(off[a : b + 1]).astype("<u4"), windows[a:b].astype("u1"), least[a:b], most[a:b], text[off[a] : off[b]]) for a, b in zip(edges, edges[1:], strict=False)]
    names = c.bins[edges[:-1]].astype(np.int32)
    block = table.column("block")[0].as_py()
    return pa.table({"bin": pa.array(names), "block": pa.array([block] * len(names), pa.int32()), "pieces": pa.array(blobs, pa.binary())})


def _ask(table: pa.Table, bins: int, hot: np.ndarray) -> pa.Table:
    """Rows (block, number, window, least, most) of a block: its hot windows, by number and digest."""
    c, least, most, n = _pieces(table, bins, hot)
    start = c.start[c.uniques[n:]]
    text, off = gather(c.text, c.at[start], c.at[start + WINDOW])
    raw = text.tobytes()
    digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)]
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(start), pa.int32()), "number": pa.array(np.arange(len(start))), "window": pa.array(digest, pa.binary()), "least": pa.array(least[n:]), "most": pa.array(most[n:])})


def first_ids(text: np.ndarray, off: np.ndarray, windows: np.ndarray, ids: np.ndarray, hash_of=None) -> np.ndarray:
    """For every window of the pieces, one after another, the least id of any piece that holds it."""
    ends = np.flatnonzero(text == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first = np.searchsorted(starts, off[:-1])
    at = spread(first, windows)
    of = np.repeat(ids, windows)
    h = (hash_of or (lambda: chains(hashes(text, starts, ends))[1]))()[at]
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    # equal hashes: the words of each window against those of the first one
    twin = np.flatnonzero(~new)
    mine, its = at[order[twin]], at[order[head[group[twin]]]]
    same = ends[mine + WINDOW - 1] - starts[mine] == ends[its + WINDOW - 1] - starts[its]
    for k in range(0, len(twin), 1 << 16):
        if same[k : k + (1 << 16)].all():
            a, b = mine[k : k + (1 << 16)], its[k : k + (1 << 16)]
            same[k] = np.array_equal(gather(text, starts[a], ends[a + WINDOW - 1])[0], gather(text, starts[b], ends[b + WINDOW - 1])[0])
    out = np.empty(len(h), np.int64)
    if same.all():
        out[order] = np.minimum.reduceat(of[order], head)[group] if len(head) else of
        return out
    # two different windows have one hash: their words decide
    raw, least = text.tobytes(), {}
    keys = [raw[starts[a] : ends[a + WINDOW - 1]] for a in at]
    for k, d in zip(keys, of.tolist(), strict=True):
        least[k] = min(d, least.get(k, d))
    return np.array([least[k] for k in keys], np.int64)


def _judge(table: pa.Table) -> pa.Table:
    """Rows (block, bin, found) of a bin: number of the piece, window in it, least id."""
    parts = [_spread_out(b, "<u4", "u1", "<i8", "<i8") for b in table.column("pieces").to_pylist()]
    size, windows, least, most = (np.concatenate([p[k] for p in parts]) for k in range(4))
    windows = windows.astype(np.int64)
    text = np.concatenate([p[4] for p in parts])
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    found = first_ids(text, off, windows, least)
    number = np.repeat(np.arange(len(windows)), windows)
    rel = spread(np.zeros(len(windows), np.int64), windows)
    gone = np.flatnonzero(found < most[number])
    edges = np.cumsum([0] + [len(p[0]) for p in parts])
    spot = np.searchsorted(number[gone], edges)
    blocks, blobs = [], []
    for k, block in enumerate(table.column("block").to_pylist()):
        own = gone[spot[k] : spot[k + 1]]
        if len(own):
            blocks.append(block)
            blobs.append(_squeeze((number[own] - edges[k]).astype("<u4"), rel[own].astype("u1"), found[own]))
    return pa.table({"block": pa.array(blocks, pa.int32()), "bin": pa.array([table.column("bin")[0].as_py()] * len(blocks), pa.int32()), "found": pa.array(blobs, pa.binary())})


def _finish(docs: pa.Table, answers: pa.Table, bins: int, hot: np.ndarray) -> pa.Table:
    """The documents of a block without the words that some smaller document's window covers."""
    ids, null, column = _documents(docs)
    c = cut(column, bins, hot)
    base = np.concatenate([[0], np.cumsum(c.windows[c.uniques])])
    first = np.full(base[-1], LAST)
    touched = np.zeros(len(c.uniques), bool)
    in_bins = answers.filter(pc.is_valid(answers.column("found")))
    for bin_, blob in zip(in_bins.column("bin").to_pylist(), in_bins.column("found").to_pylist(), strict=True):
        number, rel, least, _ = _spread_out(blob, "<u4", "u1", "<i8")
        number = number + np.searchsorted(c.bins, bin_)
        first[base[number] + rel] = least
        touched[number] = True
    asked = answers.filter(pc.is_null(answers.column("found")))
    number = asked.column("number").to_numpy().astype(np.int64) + np.searchsorted(c.bins, bins)
    first[base[number]] = asked.column("least").to_numpy()
    touched[number] = True
    some = np.flatnonzero(touched[c.number]) if len(c.number) else c.number
    start, windows = c.start[some], c.windows[some]
    covered = first[spread(base[c.number[some]], windows)] < np.repeat(ids[c.owner[some]], windows)
    word = spread(start, windows)[covered]
    n = len(c.at) - 1
    edge = np.bincount(word, minlength=n + 1)[: n + 1] - np.bincount(word + WINDOW, minlength=n + 1)[: n + 1]
    keep = np.flatnonzero(np.cumsum(edge[:n]) == 0)
    text, off = gather(c.text, c.at[keep], c.at[keep + 1])
    of = np.searchsorted(keep, c.first)
    ends = off[of]
    texts = [text[a : b - 1].tobytes().decode() if b > a else "" for a, b in zip(ends, ends[1:], strict=False)]
    n_words, n_kept = np.diff(c.first), np.diff(of)
    return pa.table({"doc_id": pa.array(ids, mask=null), "text": pa.array(texts, pa.string()), "n_words": pa.array(n_words), "n_removed": pa.array(n_words - n_kept)})


def _small(table: pa.Table) -> pa.Table:
    tables.release(cycles=False)
    return table


def _common(docs: DataFrame, bins: int, size: int) -> np.ndarray:
    """Bits of the slots of hot minimisers: those of more than HOT of a bin's share of all pieces; none if there are none.

    Pieces are drawn at a rate that shows a hot minimiser about SEEN times at least (only how windows travel
    depends on it, not what is found). There is a slot for each eighth of a bin up to 2 ** MOST_BITS
    (16 MB of bits), so what reaches the driver and the tasks is bounded; a minimiser that shares a hot slot is dealt as if hot.
    """
    rate = min(1.0, SEEN * bins / HOT * 64 / max(1, size))
    bits = min(MOST_BITS, max(FEWEST_BITS, (8 * bins - 1).bit_length()))
    most = np.uint64(min(2**64 - 1, int(rate * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            for x, y in slices(flat(text)[1], 4 << 20):
                data, starts, ends, first = _words(text[x:y])
                h = hashes(data, starts, ends)
                least = _starts(chains(h)[0], first, np.zeros(0, np.uint8))[3]
                draw = mix(np.arange(len(least), dtype=np.uint64) ^ mix(h.sum(keepdims=True)))
                value, count = np.unique(least[draw <= most], return_counts=True)
                of = np.zeros(len(value) + 1, np.int64)
                of[-1] = len(least)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(value, np.uint64(0)).view(np.int64)), pa.array(np.append(count, 0)), pa.array(of)], ["m", "n", "of"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = _slot(b.column("m").to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> CHUNK_BITS), pa.array(slot & ((1 << CHUNK_BITS) - 1))], ["chunk", "at"])

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << min(bits, CHUNK_BITS), bool)
        flags[table.column("at").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    seen = docs.select("text").mapInArrow(run, "m long, n long, of long").groupBy("m").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    seen = tables.checkpoint(seen)
    total = seen.agg(F.sum("of")).first()[0] or 0
    hot = seen.where((F.col("n") > 0) & (F.col("n") >= max(2.0, rate * total * HOT / bins))).select("m")
    found = hot.mapInArrow(slots, "chunk long, at long").distinct().groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").collect()
    if not found:
        return np.zeros(0, np.uint8)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for chunk, packed in found:
        own = np.frombuffer(bytes(packed), np.uint8)
        out[chunk * len(own) : (chunk + 1) * len(own)] = own
    return out


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed): kept words of each row of `docs`, joined by one blank.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id.
    Null and empty texts have no words. Rows with one id don't take each other's words; a null id counts
    as the greatest long, so its rows come after all others. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, bins = max(2 * n, -(-size // BLOCK_BYTES)), max(n, -(-size * 3 // BIN_BYTES))
    hot = _common(docs, bins, size)
    shared = spark.sparkContext.broadcast(hot)  # of bounded length, see _common()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = tables.Repeats()
        for whole in batches:
            yield from (_deal(b, blocks, repeats) for b in tables.parts(whole, DEAL_BYTES))
        tables.release()

    dealt = docs.mapInArrow(deal, "block int, packed binary")
    sent = dealt.groupBy("block").applyInArrow(lambda t: _small(_send(t, bins, shared.value)), "bin int, block int, pieces binary")
    answers = sent.groupBy("bin").applyInArrow(lambda t: _small(_judge(t)), "block int, bin int, found binary")
    answers = answers.selectExpr("*", "cast(null as long) as number", "cast(null as long) as least")
    if len(hot):
        asked = tables.checkpoint(dealt.groupBy("block").applyInArrow(lambda t: _small(_ask(t, bins, shared.value)), "block int, number long, window binary, least long, most long"))
        minima = asked.groupBy("window").agg(F.min("least").alias("first"), F.count("*").alias("n"))
        told = tables.attach(asked, minima, "window", asked.count()).where("first < most")
        answers = answers.union(told.selectExpr("block", "cast(null as int) as bin", "cast(null as binary) as found", "number", "first as least"))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _small(_finish(d, a, bins, shared.value)), "doc_id long, text string, n_words long, n_removed long")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, n_words, n_removed, kept_sha256. Null and empty texts have no words; a null id comes after all others; see dedup()."""
    out = dedup(spark, tables.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT k, doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM o GROUP BY g),
h AS (SELECT k, list(DISTINCT j) AS gone FROM (SELECT o.k, unnest(range(o.i, o.i + 13)) AS j FROM o JOIN f ON o.g = f.g WHERE f.least < o.doc_id) GROUP BY k),
e AS (SELECT k, doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 0),
c AS (SELECT k, unnest(gone) AS j FROM h),
s AS (SELECT e.k, string_agg(e.x, ' ' ORDER BY e.j) AS t FROM e LEFT JOIN c ON e.k = c.k AND e.j = c.j WHERE c.j IS NULL GROUP BY e.k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(h.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM d LEFT JOIN h ON d.k = h.k LEFT JOIN s ON d.k = s.k
"""
