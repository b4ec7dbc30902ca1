"""Byte-level BPE by corpus-level merge replay.

Documents are cut into pieces and dealt into blocks of bounded size, each with
the bounds of its pieces. A block sends each distinct piece that is no token by itself once to the bin
of the piece's hash, so that a piece meets its copies from all other blocks; of
more than STRETCH blocks, each STRETCH have bins of their own, so that a piece
of every block fills no bin. A bin lays its distinct pieces side by side. An inverted index from the rank of a pair
to its positions is replayed in rank order: each step takes the lowest rank
anywhere, merges its positions from left to right and re-indexes only the two
neighbours of each merge. Where a merge brings forth a pair of lower rank, the
rest of that piece waits for it, so every piece is merged as if it were alone.
The ids return to the blocks, which put their texts together from them.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables
from .textbuf import flat, gather, hashes

#: Distinct pieces that an encoder keeps at most, and the longest piece kept; others are encoded again.
KEPT, KEPT_CHARS = 200_000, 64
#: Pieces of texts taken at once, and distinct pieces merged at once.
BLOCK, MERGED = 200_000, 50_000
#: Bytes of text of a block, and of the texts that share a bin, aimed at.
BLOCK_BYTES, BIN_BYTES = 8 << 20, 32 << 20
#: Blocks that share bins (32 GB of text): a bin has at most so many rows.
STRETCH = 4096
#: Tokens are below NONE; a pair of tokens is one number.
SHIFT, NONE = 21, (1 << 21) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merges(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that makes a token, as one number, and the rank of what it makes."""
    found = [(a << SHIFT | b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
    keys, made = np.array(found, np.int64).reshape(-1, 2).T
    return keys, made


class Encoder:
    """Ids of texts under `ranks`, and bytes of ids. `pairs`: what merges() finds."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.bytes = np.full(max(ranks.values()) + 1, None, object)
        for b, r in ranks.items():
            self.bytes[r] = b
        keys, made = pairs or merges(ranks)
        self.pairs: dict[int, int] = dict(zip(keys.tolist(), made.tolist(), strict=True))
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.first = np.full((257, 257), -1)
        self.first[:256, :256] = [[self.pairs.get(a << SHIFT | b, -1) for b in self.single.tolist()] for a in self.single.tolist()]
        self.kept: dict[bytes, bytes] = {}
        tokens = [b or b"" for b in self.bytes.tolist()]
        self.flat, self.starts, self.ends = _bounds(tokens)
        self.by_hash = hashes(self.flat, self.starts, self.ends)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and the n + 1 bounds of each one's."""
        return gather(self.flat, self.starts[ids], self.ends[ids])

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        ranks = self.ranks
        out = [ranks.get(p) for p in pieces]
        todo = [k for k, r in enumerate(out) if r is None]
        gc.disable()  # the index is many small lists without cycles
        try:
            for a in range(0, len(todo), MERGED):
                part = todo[a : a + MERGED]
                for k, ids in zip(part, self._merge([pieces[k] for k in part]), strict=True):
                    out[k] = ids
        finally:
            gc.enable()
        return [x if isinstance(x, bytes) else x.to_bytes(4, "little") for x in out]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Merges all pieces at once. A token NONE stands before, between and after them, and makes no pair."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        off = np.concatenate([[0], np.cumsum(length + 1)]) + 1
        symbol = np.full(int(off[-1]), 256)
        inside = np.ones(len(symbol), bool)
        inside[off - 1] = False
        symbol[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        start = self.first[symbol[:-1], symbol[1:]] if len(symbol) > 1 else np.zeros(0, int)
        order = np.argsort(start, kind="stable")
        order = order[start[order] >= 0]
        cut = np.flatnonzero(np.diff(start[order], prepend=-1))
        at = {int(start[g[0]]): g.tolist() for g in np.split(order, cut[1:])} if len(order) else {}
        tok = np.append(self.single, NONE)[symbol].tolist()
        pair = [*start.tolist(), -1]
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        nxt[n - 1] = n - 1
        heap = sorted(at)
        known = self.pairs.get
        while heap:
            r = heappop(heap)
            places = at.pop(r, None)
            if places is None:
                continue
            places.sort()
            until = -1  # the end of a piece that waits
            for i in places:
                if pair[i] != r:
                    continue  # one of its tokens has been merged elsewhere
                if i < until:
                    at.setdefault(r, []).append(i)
                    continue
                j = nxt[i]
                k, h = nxt[j], prv[i]
                tok[i], tok[j], pair[j] = r, -1, -1
                nxt[i], prv[k] = k, i
                pair[i] = x = known(r << SHIFT | tok[k], -1)
                low = False
                if x >= 0:
                    if x in at:
                        at[x].append(i)
                    else:
                        at[x] = [i]
                        heappush(heap, x)
                    low = x < r
                pair[h] = x = known(tok[h] << SHIFT | r, -1)
                if x >= 0:
                    if x in at:
                        at[x].append(h)
                    else:
                        at[x] = [h]
                        heappush(heap, x)
                    low = low or x < r
                if low:
                    until = int(off[np.searchsorted(off, i, "right")])
            if r in at:
                heappush(heap, r)
        final = np.array(tok)
        count = np.concatenate([[0], np.cumsum((final >= 0) & (final != NONE))]) * 4
        ids = final[(final >= 0) & (final != NONE)].astype("<u4").tobytes()
        ends = count[off].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _blocks(self, text: str | None) -> Iterator[list[bytes]]:
        text = text or ""
        if len(text) <= BLOCK:
            yield [p.encode() for p in self.find.findall(text)]
            return
        found = self.find.finditer(text)
        while block := [m[0].encode() for m in islice(found, BLOCK)]:
            yield block

    def _learn(self, pieces: set[bytes]) -> list[bytes]:
        """Sees to it that `kept` has the ids of all pieces; returns those that should not stay."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = [p for p in pieces if p not in self.kept]
        self.kept.update(zip(new, self.replay(new), strict=True))
        return [p for p in new if len(p) > KEPT_CHARS]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; null reads as empty."""
        return self.encode_pieces(map(self._blocks, texts))

    def encode_pieces(self, texts: Iterable[Iterator[list[bytes]]]) -> list[bytes]:
        """encode() of texts that come as pieces, up to BLOCK of them at a time."""
        out: list[bytes] = []
        waiting: list[list[bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            try:
                found = [b"".join(map(self.kept.__getitem__, d)) for d in waiting]
            except KeyError:
                long = self._learn(set().union(*waiting))
                found = [b"".join(map(self.kept.__getitem__, d)) for d in waiting]
                for p in long:
                    del self.kept[p]
            out.extend(found)
            waiting.clear()
            size = 0

        for blocks in texts:
            parts = list(islice(blocks, 1))
            waiting.append(parts[0] if parts else [])
            size += len(waiting[-1])
            for more in blocks:  # a very long text: block after block, joined to what came before
                flush()
                head = out.pop()
                waiting.append(more)
                flush()
                out[-1] = head + out[-1]
            if size >= BLOCK:
                flush()
        flush()
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(self.bytes[np.frombuffer(ids or b"", "<u4")].tolist())


def bounds(find: regex.Pattern, text: str | None) -> bytes | None:
    """The lengths in bytes of a text's pieces: 255 says that a length goes on. None if the pieces are not the whole text."""
    out, at = [], 0
    text = text or ""
    found = iter([find.findall(text)]) if len(text) <= BLOCK else _matched(find, text)
    for block in found:
        size = np.fromiter(map(len, block), np.int64, len(block))
        total = int(size.sum())
        part = text[at : at + total]
        if len(text) > BLOCK and "".join(block) != part:
            return None
        at += total
        if not part.isascii():
            raw = np.frombuffer(part.encode(), np.uint8)
            starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            size = np.diff(starts[np.cumsum(size)], prepend=0)
        more = size // 255
        packed = np.full(len(size) + int(more.sum()), 255, np.uint8)
        packed[np.cumsum(more + 1) - 1] = size % 255
        out.append(packed.tobytes())
    return b"".join(out) if at == len(text) else None


def _matched(find: regex.Pattern, text: str) -> Iterator[list[str]]:
    found = find.finditer(text)
    while block := [m[0] for m in islice(found, BLOCK)]:
        yield block


def pieces_of(raw: bytes | None, packed: bytes) -> Iterator[list[bytes]]:
    """A text's pieces by their bounds(), up to BLOCK of them at a time."""
    raw = raw or b""
    size = np.frombuffer(packed, np.uint8)
    ends = np.cumsum(size, dtype=np.int64)[size != 255]
    at = 0
    for k in range(0, max(1, len(ends)), BLOCK):
        own = ends[k : k + BLOCK].tolist()
        yield [raw[a:b] for a, b in zip([at, *own], own, strict=False)]
        at = own[-1] if own else 0


class _Shared:
    """An encoder built once in a worker from a broadcast of ranks and pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = load_ranks(path)
        self.source, self.pattern, self.made = spark.sparkContext.broadcast((ranks, pattern, merges(ranks))), pattern, None

    def __getstate__(self) -> dict:
        return {"source": self.source, "pattern": self.pattern, "made": None}

    def get(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(*self.source.value)
        return self.made


def _squeeze(items: list[bytes]) -> bytes:
    raw = np.fromiter(map(len, items), "<u4", len(items)).tobytes() + b"".join(items)
    return struct.pack("<IQ", len(items), len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _spread_out(blob: bytes) -> list[bytes]:
    n, size = struct.unpack("<IQ", blob[:12])
    raw = pa.Codec("zstd").decompress(blob[12:], decompressed_size=size, asbytes=True)
    ends = (4 * n + np.cumsum(np.frombuffer(raw, "<u4", n))).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]


class Known:
    """The ids of pieces by the pieces' hashes: those of all tokens, and of what the bins have answered."""

    def __init__(self, encoder: Encoder, answers: list[bytes]):
        self.encoder = encoder
        parts = [_flat_ids(a) for a in answers]
        ids = np.concatenate([np.arange(len(encoder.ends), dtype=np.uint32), *(p[1] for p in parts)])
        size = np.concatenate([np.ones(len(encoder.ends), np.int64), *(p[0] for p in parts)])
        told = ids[len(encoder.ends) :].astype(np.int64)
        text, at = encoder.spell(told)
        ends = at[np.cumsum(size[len(encoder.ends) :])]
        own = hashes(text, np.append(0, ends)[:-1].astype(np.int64), ends.astype(np.int64)) if len(ends) else np.zeros(0, np.uint64)
        key = np.concatenate([encoder.by_hash, own])
        self.order = np.argsort(key, kind="stable")
        self.key, self.ids, self.size = key[self.order], ids, size
        self.first = np.cumsum(size) - size

    def encode(self, rows: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
        """The ids of dealt rows, and what these spell. Where that is not the text (two pieces have one hash), or the rows' bounds are missing, each text is encoded by itself."""
        encoder = self.encoder
        cut = rows.column(rows.num_columns - 1)
        data, off = flat(rows.column("text"))
        if cut.null_count == 0:
            starts, ends, count = _laid_out(cut)
            h = hashes(data, starts, ends)
            _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.key, h[at]), len(self.key) - 1)
            size, first, ids = self.size[self.order[place]], self.first[self.order[place]], self.ids
            if len(lost := np.flatnonzero(self.key[place] != h[at])):
                raw = data.tobytes()
                more = [np.frombuffer(x, "<u4") for x in encoder.replay([raw[starts[k] : ends[k]] for k in at[lost].tolist()])]
                size[lost] = list(map(len, more))
                first[lost] = len(ids) + np.cumsum(size[lost]) - size[lost]
                ids = np.concatenate([ids, *more])
            n = size[inverse]
            done = np.cumsum(n)
            found = ids[np.repeat(first[inverse] - done + n, n) + np.arange(int(done[-1]) if len(done) else 0)].astype("<u4")
            text, bounds_ = encoder.spell(found.astype(np.int64))
            if len(text) == len(data) and np.array_equal(bounds_[done], ends) and np.array_equal(text, data):
                rows_at = np.append(0, done)[np.append(0, np.cumsum(count))]
                return _binary(found.view(np.uint8), rows_at * 4), _binary(data, off)
        out = encoder.encode_pieces(_texts(rows, encoder))
        return pa.array(out, pa.binary()), pa.array(map(encoder.decode, out), pa.binary())


def _laid_out(cut: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces of rows one after another, and how many each row has, from their bounds()."""
    cut = cut.cast(pa.large_binary())
    at = np.frombuffer(cut.buffers()[1], np.int64)[cut.offset : cut.offset + len(cut) + 1]
    size = np.frombuffer(cut.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    whole = np.append(0, np.cumsum(size != 255))
    ends = np.cumsum(size, dtype=np.int64)[size != 255]
    return np.append(0, ends)[:-1].astype(np.int64), ends, np.diff(whole[at])


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _flat_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each item of a squeezed list has, and all of them."""
    n, size = struct.unpack("<IQ", blob[:12])
    raw = pa.Codec("zstd").decompress(blob[12:], decompressed_size=size, asbytes=True)
    return np.frombuffer(raw, "<u4", n).astype(np.int64) // 4, np.frombuffer(raw, "<u4", offset=4 * n)


def _deal(rows: pa.RecordBatch, block: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of a batch that go to each block."""
    order = np.argsort(block, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows.take(pa.array(own)))
        yield int(block[own[0]]), sink.getvalue().to_pybytes()


def _dealt(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for blob in table.column("packed"):
        with pa.ipc.open_stream(blob.as_buffer()) as rows:
            yield from rows


def _corpus(spark: SparkSession, docs: DataFrame, path: str, pattern: str, fields: str) -> DataFrame:
    """`docs` with token_ids and, if among `fields`, decoded.

    A bin holds a piece once for each block of its stretch that has it, so the pieces that a block sends to all bins
    together are fewer than its words; pieces that are tokens are sent nowhere. Should a block meet a piece that it
    has no answer for, it merges that piece itself. Rows are dealt by a hash of all their columns (maps aside), alike ones
    32 at a time, so a repeated task deals them alike.
    """
    shared = _Shared(spark, path, pattern)
    more = StructType.fromDDL(fields)
    docs = docs.drop(*more.names)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, bins = max(n, -(-size // BLOCK_BYTES)), max(n, -(-min(size, STRETCH * BLOCK_BYTES) // BIN_BYTES))  # bins of a stretch

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, find = tables.Repeats(), regex.compile(shared.pattern)
        for whole in batches:
            for b in tables.parts(whole, 2 * BLOCK_BYTES):
                block = (tables.shares(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), repeats) % np.uint64(blocks)).astype(np.int64)
                cut = pa.array([bounds(find, t) for t in b.column("text").to_pylist()], pa.binary())
                found = list(_deal(pa.RecordBatch.from_arrays([*b.columns[:-1], cut], [*b.schema.names[:-1], "cut"]), block))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["block", "packed"])
        tables.release()

    def send(table: pa.Table) -> pa.Table:
        own, encoder = set(), shared.get()
        for b in _dealt(table):
            cut = b.column(b.num_columns - 1)
            if cut.null_count:
                for text in _texts(b, encoder):
                    own.update(*text)
                continue
            data, _ = flat(b.column("text"))
            starts, ends, _ = _laid_out(cut)
            at = np.unique(hashes(data, starts, ends), return_index=True)[1]  # should two pieces have one hash, the block merges one of them itself
            raw = data.tobytes()
            own.update(raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True))
        pieces = [p for p in own if p not in encoder.ranks]
        block = table.column("block")[0].as_py()
        bin_ = block // STRETCH * bins + (hashes(*_bounds(pieces)) % np.uint64(bins)).astype(np.int64)
        order = np.argsort(bin_, kind="stable")
        out = [(int(bin_[g[0]]), _squeeze([pieces[k] for k in g.tolist()])) for g in np.split(order, np.flatnonzero(np.diff(bin_[order])) + 1) if len(g)]
        del own, pieces
        tables.release(cycles=False)
        return pa.table({"bin": pa.array([k for k, _ in out], pa.int32()), "block": pa.array([block] * len(out), pa.int32()), "pieces": pa.array([x for _, x in out], pa.binary())})

    def replay(table: pa.Table) -> pa.Table:
        asked = [_spread_out(b) for b in table.column("pieces").to_pylist()]
        pieces = list(set().union(*asked))
        ids = dict(zip(pieces, shared.get().replay(pieces), strict=True))
        out = [_squeeze(list(map(ids.__getitem__, own))) for own in asked]  # ids tell their piece
        del asked, pieces, ids
        tables.release(cycles=False)
        return pa.table({"block": table.column("block"), "answer": pa.array(out, pa.binary())})

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known = Known(shared.get(), answers.column("answer").to_pylist())
        out = []
        for b in _dealt(rows):
            ids, decoded = known.encode(b)
            made = {"token_ids": ids} | ({"decoded": decoded} if "decoded" in more.names else {})
            out.append(pa.RecordBatch.from_arrays([*b.columns[:-1], *made.values()], [*b.schema.names[:-1], *made]))
        del known
        tables.release(cycles=False)
        return pa.Table.from_batches(out)

    hashed = [docs[f"`{c}`"] for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    dealt = docs.withColumn(tables.fresh(docs, "key"), F.xxhash64(*hashed)).mapInArrow(deal, "block int, packed binary")
    sent = dealt.groupBy("block").applyInArrow(send, "bin int, block int, pieces binary")
    answers = sent.groupBy("bin").applyInArrow(replay, "block int, answer binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, StructType([*docs.schema.fields, *more.fields]))


def _texts(rows: pa.RecordBatch, encoder: Encoder) -> Iterator[Iterator[list[bytes]]]:
    """The pieces of each text of dealt rows, by their bounds (the last column) or, without these, cut anew."""
    for text, cut in zip(rows.column("text"), rows.column(rows.num_columns - 1), strict=True):
        yield pieces_of(text.as_buffer().to_pybytes() if text.is_valid else b"", cut.as_py()) if cut.is_valid else encoder._blocks(text.as_py())


def _bounds(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], ends])[:-1].astype(np.int64), ends


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with token_ids, the ids of `text` as little-endian 32-bit integers.

    `path` is a rank file that the driver can read; special tokens are ordinary text.
    Null and empty texts have no ids; rows are encoded one by one, whatever their ids, repeats and other
    columns are. An earlier column token_ids is replaced.
    """
    return _corpus(spark, docs, path, pattern, "token_ids binary")


def decode(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with decoded, the bytes that token_ids stand for; null ids give no bytes. An earlier column decoded is replaced."""
    shared = _Shared(spark, path, pattern)
    return tables.append(docs, "decoded binary", lambda b: [pa.array([shared.get().decode(x) for x in b.column("token_ids").to_pylist()], pa.binary())])


def round_trip(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode() and decode() of what it returned, in one pass over `docs`."""
    return _corpus(spark, docs, path, pattern, "token_ids binary, decoded binary")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no tokens; ids don't matter; see encode()."""
    import public_tokenizers

    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of `docs` with n_tokens, token_ids and round_trip (the ids decode to the text), which replace earlier columns of these names.

    Null and empty texts have no tokens; ids, repeats and other columns don't matter; an empty table stays empty.
    """
    import public_tokenizers

    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "token_ids", "round_trip")]
    out = round_trip(spark, tables.packed(docs.select(*[docs[f"`{c}`"] for c in kept])), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in kept]
    return out.select(*own, F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"), "token_ids", same.alias("round_trip"))
