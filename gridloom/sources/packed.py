"""Storage in types chosen at run time: each tile's positions and values as packed binaries of the narrowest types that hold them exactly."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..plans.selection import Selection

#: Rows and columns of a tile, which is packed by one call; it has a million cells at most.
TILE = (1024, 1024)
#: Entries of small tiles that are handed to Spark together, at least.
TOGETHER = 65_536
#: From narrow to wide.
KINDS = ("int8", "int16", "int32", "int64", "float32", "float64")
_PACKED = "tr long, tc long, n long, row_kind string, column_kind string, value_kind string, rows binary, columns binary, values binary"
_DTYPES = {"double": "float64", "float": "float32", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64"}


def narrowest(values: np.ndarray) -> str:
    """The first of KINDS that holds all values exactly; -0.0, NaN and infinity need a float."""
    whole = values.dtype.kind in "iu"
    if not whole and len(values):
        whole = bool(np.isfinite(values).all() and (values == np.rint(values)).all() and (np.abs(values) < 2.0**62).all() and not np.signbit(values[values == 0]).any())
    if whole or len(values) == 0:
        least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        return next(k for k in KINDS if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    with np.errstate(over="ignore"):
        short = values.astype(np.float32).astype(float)
    return "float32" if np.array_equal(short, values, equal_nan=True) else "float64"


def _kinds(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """narrowest() of each stretch of values; whole numbers by their extremes, which are found for all stretches at once."""
    if values.dtype.kind not in "iu":
        with np.errstate(invalid="ignore"):
            odd = ~(np.isfinite(values) & (values == np.rint(values)) & (np.abs(values) < 2.0**62)) | ((values == 0) & np.signbit(values))
        odd = np.logical_or.reduceat(odd, starts)
        out = [narrowest(values[a:b]) if x else "" for a, b, x in zip(starts.tolist(), ends.tolist(), odd.tolist(), strict=True)]
    else:
        out = [""] * len(starts)
    least, most = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    if values.dtype.kind == "f":  # no limit but int64's is rounded in a double
        least, most = least.astype(float), most.astype(float)
    for kind in reversed(KINDS[:4]):
        # limits of int64 as doubles are one too high, but whole doubles are below 2 ** 62 here
        for k in np.flatnonzero((least >= np.iinfo(kind).min) & (most <= np.iinfo(kind).max)):
            if out[k] not in KINDS[4:]:
                out[k] = kind
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tr, tc, n, kinds, binaries) of entries that are sorted by tile; a batch's last tile waits for the next batch."""
    names = _PACKED.replace(",", "").split()[::2]
    rest: list[pa.RecordBatch] = []

    def packed(t: pa.Table) -> pa.RecordBatch:
        tr, tc, r, c, v = (t.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("tr", "tc", "r", "c", "v"))
        starts = _starts(tr, tc)
        ends = np.append(starts[1:], len(tr))
        out = {"tr": pa.array(tr[starts]), "tc": pa.array(tc[starts]), "n": pa.array(ends - starts)}
        for name, one, x in (("rows", "row_kind", r), ("columns", "column_kind", c), ("values", "value_kind", v)):
            kinds = _kinds(x, starts, ends)
            as_kind = {k: x.astype(np.dtype(k).newbyteorder("<")) if len(set(kinds)) == 1 else None for k in set(kinds)}
            out[one] = pa.array(kinds)
            out[name] = pa.array([(x[a:b].astype(np.dtype(k).newbyteorder("<")) if as_kind[k] is None else as_kind[k][a:b]).tobytes() for k, a, b in zip(kinds, starts.tolist(), ends.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([out[x] for x in names], names)

    for b in batches:
        if b.num_rows == 0:
            continue
        last = int(_starts(*(b.column(x).to_numpy(zero_copy_only=False) for x in ("tr", "tc")))[-1])
        if rest and (rest[-1].column("tr")[-1], rest[-1].column("tc")[-1]) != (b.column("tr")[0], b.column("tc")[0]):
            yield packed(pa.Table.from_batches(rest))
            rest = []
        if last:
            yield packed(pa.Table.from_batches([*rest, b.slice(0, last)]))
            rest = []
        rest.append(b.slice(last))
    if rest:
        yield packed(pa.Table.from_batches(rest))


def _starts(tr: np.ndarray, tc: np.ndarray) -> np.ndarray:
    """Where a tile's entries begin."""
    return np.flatnonzero(np.append(True, (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1])))


def write_packed(m: Matrix, path: str, tile: tuple[int, int] = TILE, mode: str = "errorifexists") -> None:
    """Stores the entries of a matrix whose absent cells are zero; others are stored by all their cells."""
    if not m.structural():
        m = m.with_(entries=m.cells(), full=True, fill=None, vectors=())
    high, wide = tile
    own = m.entries.select(F.expr(f"r div {high}L").alias("tr"), F.expr(f"c div {wide}L").alias("tc"), F.expr(f"r % {high}L").alias("r"), F.expr(f"c % {wide}L").alias("c"), "v")
    # entries move once, by ranges of tiles, so a tile's entries follow each other in one task
    sorted_ = own.repartitionByRange("tr", "tc").sortWithinPartitions("tr", "tc", "r", "c")
    sorted_.mapInArrow(_pack, _PACKED).write.mode(mode).parquet(f"{path}/packed")
    told = {"nrow": m.nrow, "ncol": m.ncol, "dtype": m.dtype, "sparse": m.sparse, "full": m.full, "p_sparse": m.p_sparse, "p_rows": m.p_rows, "tile": [high, wide]}
    m.entries.sparkSession.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode(mode).text(f"{path}/shape")


def packed_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The stored tiles: their places, entries, types and binaries."""
    return spark.read.parquet(f"{path}/packed")


def open_packed(spark: SparkSession, path: str) -> Matrix:
    """A matrix stored by write_packed(). Selected rows and columns reach the scan as ranges of tiles."""
    told = json.loads(spark.read.text(f"{path}/shape").first()[0])
    nrow, ncol, (high, wide), dtype = told["nrow"], told["ncol"], told["tile"], told["dtype"]
    tiles = packed_tiles(spark, path)
    kind = np.dtype(_DTYPES.get(dtype, "float64"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def shown() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["r", "c", "v"])

        for b in batches:
            for t in (row for k in range(0, b.num_rows, 64) for row in b.slice(k, 64).to_pylist()):
                r, c, v = (np.frombuffer(t[x], np.dtype(t[k]).newbyteorder("<")) for x, k in (("rows", "row_kind"), ("columns", "column_kind"), ("values", "value_kind")))
                held.append((r.astype(np.int64) + t["tr"] * high, c.astype(np.int64) + t["tc"] * wide, v.astype(kind)))
                size += len(r)
                if size >= TOGETHER:
                    yield shown()
                    held, size = [], 0
        if held:
            yield shown()

    def decoded(some: DataFrame) -> DataFrame:
        return some.drop("n").mapInArrow(unpack, f"r long, c long, v {dtype}")

    def reader(rows: Selection, columns: Selection) -> DataFrame:
        some = columns.grouped(wide).keep(rows.grouped(high).keep(tiles, "tr", -(-nrow // high)), "tc", -(-ncol // wide))
        return columns.keep(rows.keep(decoded(some), "r", nrow), "c", ncol)

    return Matrix(decoded(tiles), nrow, ncol, sparse=told["sparse"], full=told["full"], p_sparse=told["p_sparse"], p_rows=told["p_rows"], dtype=dtype, reader=reader)
