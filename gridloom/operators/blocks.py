"""User functions over blocks of a matrix.

A block is a range of lines (rows, or columns) by a range of positions along them. Each is one group of an Arrow
function, of bounded size whatever the matrix: only entries are shuffled, with one row for each block and, where
the fill of absent cells differs by line or by position, its values for the block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..plans.extract import by_line, fill_of

#: Cells of a dense block at most; also entries of a sparse one.
CELLS = 1 << 22


@dataclass(frozen=True)
class Csr:
    """The entries of a block by line: those of line k are at places starts[k] to starts[k + 1]; indices count from the block's first position."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape, self.values.dtype)
        out[np.repeat(np.arange(self.shape[0]), np.diff(self.starts)), self.indices] = self.values
        return out


@dataclass(frozen=True)
class Place:
    """Where a block is: its first line and their number, its first position along the lines and their number."""

    start: int
    length: int
    first: int
    width: int


_DTYPES = {"double": np.float64, "float": np.float32, "tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "byte": np.int8, "short": np.int16, "integer": np.int32, "long": np.int64}


def map_blocks(m: Matrix, fun: Callable[[Place, np.ndarray | Csr], Mapping[str, object]], schema: str, *, by_row: bool = True, length: int | None = None, width: int | None = None, sparse: bool = False) -> DataFrame:
    """What `fun(place, block)` returns, columns by name with the types of the DDL string `schema`, for every block of the matrix.

    The block is an array of lines by positions or, with `sparse`, a Csr of the entries of a matrix whose absent cells are zero.
    Blocks have `length` lines (the last one fewer) and `width` positions: all of them unless told otherwise, as long as that makes no more than CELLS
    cells. Every block comes once, also one without entries; a matrix without rows or columns has none. `fun` runs in the
    workers, each time on one block.
    """
    lines, extent = (m.nrow, m.ncol) if by_row else (m.ncol, m.nrow)
    if sparse and not m.structural():
        raise ValueError("absent cells that aren't zero have no sparse form; read such a matrix in dense blocks")
    width = min(max(1, extent), width or CELLS)
    length = min(max(1, lines), length or max(1, CELLS // width))
    if length * width > CELLS:
        width = max(1, CELLS // length) if length <= CELLS else 1
        length = min(length, CELLS)
    spark = m.entries.sparkSession
    if m.fill is not None and not m.full and not (by_line(m, True) or by_line(m, False)):
        m = m.with_(entries=m.cells(), full=True, fill=None, vectors=())
    p, s = ("r", "c") if by_row else ("c", "r")
    downs, acrosses = -(-lines // length), -(-extent // width)
    own = m.entries.select(F.expr(f"{p} div {length}L").alias("b"), F.expr(f"{s} div {width}L").alias("q"), F.lit(0).alias("kind"), F.col(p).alias("p"), F.col(s).alias("s"), F.col("v").alias("v"))
    n = downs * acrosses if lines and extent else 0
    none = F.lit(None).cast("long")
    constant = F.lit(None).cast(m.dtype) if m.vectors or m.full else fill_of(m)
    marks = spark.range(n).select(F.expr(f"id div {acrosses}L" if n else "id").alias("b"), F.expr(f"id % {acrosses}L" if n else "id").alias("q"), F.lit(1).alias("kind"), none.alias("p"), none.alias("s"), constant.alias("v"))
    rows = own.unionByName(marks)
    if m.vectors and not m.full:
        rows = rows.unionByName(_fills(m, m.vectors[0].by_row == by_row, lines, extent, length, width, downs, acrosses))
    kinds = m.dtype

    def run(t: pa.Table) -> pa.Table:
        get = {c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("b", "q", "kind")}
        b, q = int(get["b"][0]), int(get["q"][0])
        place = Place(b * length, min(length, lines - b * length), q * width, min(width, extent - q * width))
        values = t.column("v").combine_chunks()

        def of(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = pa.array(np.flatnonzero(get["kind"] == kind))
            p, s = (t.column(c).combine_chunks().take(at).fill_null(0).to_numpy(zero_copy_only=False) for c in ("p", "s"))
            # a NaN may come as null
            v = np.asarray(values.take(at).fill_null(0 if _DTYPES[kinds] not in (np.float32, np.float64) else float("nan")).to_numpy(zero_copy_only=False), _DTYPES[kinds])
            return p - place.start, s - place.first, v

        line, position, v = of(0)
        if sparse:
            order = np.lexsort((position, line))
            starts = np.searchsorted(line[order], np.arange(place.length + 1))
            block = Csr(starts, position[order], v[order], (place.length, place.width))
        else:
            block = np.zeros((place.length, place.width), _DTYPES[kinds])
            if (get["kind"] == 1).any() and values.take(pa.array(np.flatnonzero(get["kind"] == 1)))[0].is_valid:
                block[:] = of(1)[2][0]
            at, _, fill = of(2)
            block[at] = fill[:, None]
            _, at, fill = of(3)
            block[:, at] = fill[None, :]
            block[line, position] = v
        out = fun(place, block)
        return pa.table({name: x if isinstance(x, pa.Array) else pa.array(x) for name, x in out.items()})

    return rows.groupBy("b", "q").applyInArrow(run, schema)


def _fills(m: Matrix, by_lines: bool, lines: int, extent: int, length: int, width: int, downs: int, acrosses: int) -> DataFrame:
    """The fill of each line for each block across (kind 2), or of each position for each block down (kind 3)."""
    spark = m.entries.sparkSession
    name = "r" if m.vectors[0].by_row else "c"
    values = spark.range(lines if by_lines else extent).select(F.col("id").alias(name))
    for vector in m.vectors:
        values = vector.join(values)
    values = values.select(F.col(name).alias("i"), fill_of(m).alias("v"))
    none = F.lit(None).cast("long")
    if by_lines:
        return values.select(F.expr(f"i div {length}L").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(acrosses - 1).cast("long"))).alias("q"), F.lit(2).alias("kind"), F.col("i").alias("p"), none.alias("s"), "v")
    return values.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(downs - 1).cast("long"))).alias("b"), F.expr(f"i div {width}L").alias("q"), F.lit(3).alias("kind"), none.alias("p"), F.col("i").alias("s"), "v")
