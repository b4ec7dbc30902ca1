"""Vectorised views of Arrow text columns: flat bytes, word bounds and hashes.

Everything works on one UTF-8 byte buffer per slice of a batch, so the cost per
document is a few array operations instead of a Python loop over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporary arrays of a worker.
SLICE_BYTES = 1 << 20
GATHERED = 1 << 18

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent 64-bit hash of two hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 bounds of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.fill_null(pc.cast(column, pa.large_string()), ""), pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    off = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes and at most `rows` rows; one long row is a range of its own."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1), a + rows)
        yield a, b
        a = b


def runs(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero class in a row, and the first run of each row."""
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[off] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] != 0
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, off)


def byte_classes(**classes: str | bytes | range) -> np.ndarray:
    """A 256-entry table of class numbers, 1 for the first class named and so on."""
    table = np.zeros(256, np.uint8)
    for number, members in enumerate(classes.values(), 1):
        for b in members.encode() if isinstance(members, str) else members:
            table[b] = number
    return table


#: Everything but ASCII white space is a word byte.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by eight bytes at a time."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = (ends - starts).astype(np.int64)
    out = mix((eight[starts] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64))
    left, k = np.flatnonzero(length > 8), 8
    while len(left):
        more = eight[starts[left] + k] & _MASK[np.minimum(length[left] - k, 8)]
        out[left] = pair(out[left], more)
        k += 8
        left = left[length[left] > k]
    return out


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges one after another, and their n + 1 bounds; index arrays cover GATHERED bytes at a time."""
    length = ends - starts
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    out = np.empty(int(off[-1]), np.uint8)
    for a, b in slices(off, GATHERED):
        if b == a + 1:
            out[off[a] : off[b]] = data[starts[a] : ends[a]]
            continue
        index = np.arange(off[a], off[b], dtype=np.int64)
        index += np.repeat(starts[a:b] - off[a:b], length[a:b])
        out[off[a] : off[b]] = data[index]
    return out, off


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers for each i, one after another."""
    off = np.cumsum(count) - count
    return np.arange(int(count.sum()), dtype=np.int64) + np.repeat(first - off, count)
