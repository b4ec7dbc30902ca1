"""Elementwise operations on two matrices of one shape.

Entries of both sides meet by one aggregation over their union, so selections of
rows and columns reach both sources; where only cells with entries on both sides count, by an inner join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee, whole
from ..functions.ieee import d
from ..matrix import Matrix


@dataclass(frozen=True)
class BinaryHelper:
    """A custom operation: `expr(left, right, r, c)`; `keeps_zero` if it makes zero of two zeros.

    One that doesn't, and is `positional` (may use r and c), is applied to all cells.
    """

    expr: Callable[[Column, Column, Column, Column], Column]
    keeps_zero: bool = False
    both: bool = False
    positional: bool = True


_SPARSE = {
    "arithmetic": {"add", "subtract", "multiply"},
    "compare": {"greater", "less", "not_equal"},
    "boolean": {"and", "or", "xor"},
}


def _fill(m: Matrix) -> Column:
    return F.lit(0) if m.fill is None else m.fill


def combine(left: Matrix, right: Matrix, helper: BinaryHelper, dtype: str = "double", number: Callable[[Column], Column] = d) -> Matrix:
    """`number` makes the operands of the cells; doubles, unless an operation works on other types."""
    if (left.nrow, left.ncol) != (right.nrow, right.ncol):
        raise ValueError(f"the matrices should have one shape; they have {left.nrow} x {left.ncol} and {right.nrow} x {right.ncol}")
    sparse = helper.keeps_zero and left.sparse and right.sparse
    if helper.positional and not (helper.keeps_zero and left.fill is None and right.fill is None) and not (left.full or right.full):
        left = left.with_(entries=left.cells(), full=True, fill=None, vectors=())
    plain = left.fill is None and right.fill is None
    full = left.full or right.full

    def made(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = (x.select("r", "c", number(F.col("v")).alias(n)) for x, n in ((a, "lv"), (b, "rv")))
        if (helper.both and plain and not full) or (left.full and right.full):
            met = a.join(b, ["r", "c"])
        else:
            nothing = F.lit(None).cast(a.schema["lv"].dataType)
            met = a.withColumn("rv", nothing).union(b.select("r", "c", nothing.alias("lv"), "rv")).groupBy("r", "c").agg(F.max("lv").alias("lv"), F.max("rv").alias("rv"))
            for vector in (*(() if left.full else left.vectors), *(() if right.full else right.vectors)):
                met = vector.join(met)
        value = helper.expr(F.coalesce("lv", number(_fill(left))), F.coalesce("rv", number(_fill(right))), F.col("r"), F.col("c"))
        return met.select("r", "c", value.cast(dtype).alias("v"))

    fill = None if full or (helper.keeps_zero and plain) else helper.expr(number(_fill(left)), number(_fill(right)), F.col("r"), F.col("c"))
    return Matrix(
        made(left.entries, right.entries),
        left.nrow,
        left.ncol,
        sparse=sparse,
        full=full,
        fill=fill,
        vectors=() if fill is None else (*left.vectors, *right.vectors),
        p_sparse=(left.p_sparse + right.p_sparse) / 2 if helper.keeps_zero else 0.0,
        p_rows=(left.p_rows + right.p_rows) / 2,
        dtype=dtype,
        reader=lambda rows, columns: made(left.narrowed(rows, columns), right.narrowed(rows, columns)),
    )


def arithmetic(left: Matrix, right: Matrix, op: str) -> Matrix:
    """Two matrices of whole numbers make whole numbers, exactly (see functions/whole.py), but for divide and power; all else is double."""
    kind = whole.promoted(whole.type_of(left.dtype), whole.type_of(right.dtype))
    if kind is not None and op in whole.EXACT:
        exact = whole.EXACT[op]
        return combine(left, right, BinaryHelper(lambda a, b, r, c: exact(a, b), op in _SPARSE["arithmetic"], positional=False), kind, lambda x: x.cast(kind))
    f = ieee.ARITHMETIC[op]
    return combine(left, right, BinaryHelper(lambda a, b, r, c: f(a, b), op in _SPARSE["arithmetic"], positional=False))


def compare(left: Matrix, right: Matrix, op: str, dtype: str = "double") -> Matrix:
    f = ieee.COMPARE[op]
    return combine(left, right, BinaryHelper(lambda a, b, r, c: f(a, b).cast("double"), op in _SPARSE["compare"], positional=False), dtype)


def boolean(left: Matrix, right: Matrix, op: str, dtype: str = "double") -> Matrix:
    """`and` has entries where both sides have; the others where either has."""
    f = ieee.BOOLEAN[op]
    return combine(left, right, BinaryHelper(lambda a, b, r, c: f(a, b).cast("double"), op in _SPARSE["boolean"], op == "and", positional=False), dtype)
