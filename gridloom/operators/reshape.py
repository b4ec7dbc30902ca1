"""Subsets, blocks, transposition, binding, casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import LISTED, Matrix, Vector
from ..plans.selection import Selection, every


def _position(by_row: bool) -> str:
    return "r" if by_row else "c"


def _resized(m: Matrix, by_row: bool, n: int, **changes) -> Matrix:
    return m.with_(**({"nrow": n} if by_row else {"ncol": n}), **changes)


def subset_block(m: Matrix, start: int, length: int, by_row: bool) -> Matrix:
    """Positions start .. start + length - 1; a range predicate that reaches the source."""
    extent = m.nrow if by_row else m.ncol
    if start < 0 or length < 0 or start + length > extent:
        raise IndexError("the block goes beyond the extent")
    p = _position(by_row)

    def cut(df: DataFrame, name: str) -> DataFrame:
        return df.where((F.col(name) >= start) & (F.col(name) < start + length)).withColumn(name, F.col(name) - F.lit(start).cast("long"))

    def reader(rows: Selection, columns: Selection) -> DataFrame:
        there = m.narrowed(rows.moved(start), columns) if by_row else m.narrowed(rows, columns.moved(start))
        return there.withColumn(p, F.col(p) - F.lit(start).cast("long")).select("r", "c", "v")

    vectors = tuple(Vector(v.name, cut(v.rows, "i"), v.by_row, v.small) if v.by_row == by_row else v for v in m.vectors)
    part = Selection(start, length)
    own = m.narrowed(*((part, every(m.ncol)) if by_row else (every(m.nrow), part)))
    return _resized(m, by_row, length, entries=own.withColumn(p, F.col(p) - F.lit(start).cast("long")).select("r", "c", "v"), vectors=vectors, reader=reader)


def subset(m: Matrix, positions: Sequence[int] | DataFrame, by_row: bool, length: int | None = None) -> Matrix:
    """Output position k is input position positions[k]; any order, repeated ones replicate.

    The kind is chosen by shape: consecutive positions are a block, others a join with the mapping,
    which is sent to all tasks if the driver holds it and it is short. A table has columns (new, old) and needs `length`.
    """
    extent = m.nrow if by_row else m.ncol
    if isinstance(positions, DataFrame):
        if length is None:
            raise ValueError("a table of positions needs its length")
        held = None
        mapping, n = positions.select(F.col("new").cast("long").alias("new"), F.col("old").cast("long").alias("old")), length
        small = False
    else:
        listed = [int(x) for x in positions]
        if any(not 0 <= x < extent for x in listed):
            raise IndexError("a position goes beyond the extent")
        if listed and listed == list(range(listed[0], listed[0] + len(listed))):
            return subset_block(m, listed[0], len(listed), by_row)
        n, small = len(listed), len(listed) <= LISTED
        held = listed if small else None
        mapping = m.entries.sparkSession.createDataFrame(list(enumerate(listed)), "new long, old long")
    p, o = _position(by_row), _position(not by_row)

    def moved(df: DataFrame, name: str, rest: list[str]) -> DataFrame:
        to = mapping.withColumnRenamed("old", name)
        return df.join(F.broadcast(to) if small else to, name).select(F.col("new").alias(name), *rest)

    def reader(rows: Selection, columns: Selection) -> DataFrame:
        chosen = rows if by_row else columns
        ks = chosen.listed if chosen.listed is not None else range(chosen.start, chosen.start + chosen.length)
        olds = Selection.listing(tuple(sorted({held[k] for k in ks})))
        there = m.narrowed(olds, columns) if by_row else m.narrowed(rows, olds)
        return chosen.keep(moved(there, p, [o, "v"]), p, n).select("r", "c", "v")

    entries = moved(m.entries, p, [o, "v"]).select("r", "c", "v")
    vectors = tuple(Vector(v.name, moved(v.rows, "i", v.name.split(",")), v.by_row, v.small and small) if v.by_row == by_row else v for v in m.vectors)
    return _resized(m, by_row, n, entries=entries, vectors=vectors, reader=None if held is None else reader)


def subset_sorted(m: Matrix, positions: Sequence[int], by_row: bool) -> Matrix:
    if any(b < a for a, b in zip(positions, positions[1:], strict=False)):
        raise ValueError(f"subset should be in order, but its positions decrease after place {next(k for k, (a, b) in enumerate(zip(positions, positions[1:], strict=False)) if b < a)}")
    return subset(m, positions, by_row)


def subset_unique(m: Matrix, positions: Sequence[int], by_row: bool) -> Matrix:
    if len(set(positions)) != len(positions):
        raise ValueError(f"subset should be of distinct positions; {len(positions)} of them have {len(set(positions))} values")
    return subset(m, positions, by_row)


def subset_sorted_unique(m: Matrix, positions: Sequence[int], by_row: bool) -> Matrix:
    if any(b <= a for a, b in zip(positions, positions[1:], strict=False)):
        raise ValueError(f"subset should be increasing, but its positions don't increase after place {next(k for k, (a, b) in enumerate(zip(positions, positions[1:], strict=False)) if b <= a)}")
    return subset(m, positions, by_row)


def transpose(m: Matrix) -> Matrix:
    vectors = tuple(Vector(v.name, v.rows, not v.by_row, v.small) for v in m.vectors)

    def turned(df: DataFrame) -> DataFrame:
        return df.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")

    return m.with_(entries=turned(m.entries), nrow=m.ncol, ncol=m.nrow, vectors=vectors, p_rows=1.0 - m.p_rows, reader=lambda rows, columns: turned(m.narrowed(columns, rows)))


def transpose_buffer(df: DataFrame, nrow: int, ncol: int, stride: int | None = None, to_stride: int | None = None) -> DataFrame:
    """(k, v) of a row-major buffer as that of its transpose, `stride` and `to_stride` places from row to row (ncol and nrow at least); what lies between rows is left out."""
    stride, to_stride = ncol if stride is None else stride, nrow if to_stride is None else to_stride
    if stride < ncol or to_stride < nrow:
        raise ValueError("a stride should not be less than the length of a row")
    r, c = F.expr(f"k div {max(1, stride)}L"), F.expr(f"k % {max(1, stride)}L")
    return df.where((r < nrow) & (c < ncol)).select((c * to_stride + r).alias("k"), "v")


def bind(matrices: Sequence[Matrix], by_row: bool, spark=None) -> Matrix:
    """One after another along the rows (by_row) or columns. No matrix at all gives 0 x 0, for which `spark` is needed."""
    if not matrices:
        from ..sources.leaves import constant

        return constant(spark, 0, 0, 0.0).with_(sparse=False, p_sparse=0.0, p_rows=0.0)
    other = {m.ncol if by_row else m.nrow for m in matrices}
    if len(other) > 1:
        raise ValueError(f"what is bound should have the same number of {'columns' if by_row else 'rows'}; found {sorted(other)}")
    extents = [m.nrow if by_row else m.ncol for m in matrices]
    total = sum(extents)
    kept = [(m, n, sum(extents[:k])) for k, (m, n) in enumerate(zip(matrices, extents, strict=True)) if n] or [(matrices[0], extents[0], 0)]
    if len(kept) == 1:
        return kept[0][0]
    p = _position(by_row)
    dtype = kept[0][0].dtype if len({m.dtype for m, *_ in kept}) == 1 else "double"
    spark = kept[0][0].entries.sparkSession

    def reader(rows: Selection, columns: Selection) -> DataFrame:
        """The union of what the matrices that hold selected positions have there, asked by their own positions."""
        out = None
        for m, n, start in kept:
            part = (rows if by_row else columns).within(start, n)
            if part.length == 0:
                continue
            where = (part, columns) if by_row else (rows, part)
            own = (m.narrowed(*where) if m.structural() else m.cells(*where)).select("r", "c", F.col("v").cast(dtype).alias("v"))
            own = own.withColumn(p, F.col(p) + F.lit(start).cast("long"))
            out = own if out is None else out.unionByName(own)
        none = spark.range(0).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(None).cast(dtype).alias("v"))
        return none if out is None else out.select("r", "c", "v")
    share = lambda of: sum(getattr(m, of) * n for m, n, _ in kept) / total
    sparse = share("p_sparse")
    nrow, ncol = (total, other.pop()) if by_row else (other.pop(), total)
    return Matrix(reader(every(nrow), every(ncol)), nrow, ncol, reader=reader, sparse=sparse > 0.5, full=all(m.full or not m.structural() for m, *_ in kept), p_sparse=sparse, p_rows=share("p_rows"), dtype=dtype)


def cast(m: Matrix, dtype: str, index: str | None = None) -> Matrix:
    """Change the value type; a value that doesn't fit is an error. `index` checks that positions fit a type."""
    if index is not None:
        most = {"tinyint": 2**7, "byte": 2**7, "smallint": 2**15, "short": 2**15, "int": 2**31, "integer": 2**31, "bigint": 2**63, "long": 2**63}[index]
        if max(m.nrow, m.ncol) > most:
            raise OverflowError("the extent doesn't fit the index type")
    fill = None if m.fill is None else m.fill.cast(dtype)

    def made(df: DataFrame) -> DataFrame:
        return df.select("r", "c", F.col("v").cast(dtype).alias("v"))

    return m.with_(entries=made(m.entries), fill=fill, dtype=dtype, reader=lambda rows, columns: made(m.narrowed(rows, columns)))


def forced_dense(m: Matrix) -> Matrix:
    """Reports dense; what a sparse read returns stays."""
    return m.with_(sparse=False, p_sparse=0.0)
