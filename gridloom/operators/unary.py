"""Elementwise operations with nothing, a scalar, or a value for each row or column.

Entries go through one projection. An operation that does not keep zero leaves
absent cells absent and applies itself to the matrix's fill instead.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee, whole
from ..functions.ieee import d
from ..matrix import LISTED, Matrix, Vector

_names = itertools.count()

#: What each operation makes of two numbers on the driver; only used to tell whether zero is kept.
_NUMBERS = {
    "add": np.add,
    "subtract": np.subtract,
    "multiply": np.multiply,
    "divide": np.divide,
    "power": np.power,
    "modulo": lambda a, b: np.where(b == 0, np.nan, np.fmod(a, b) + np.where((np.divide(a, b) < 0) & (np.fmod(a, b) != 0), b, 0)),
    "integer_divide": lambda a, b: np.floor(np.divide(a, b)),
}
_COMPARED = {"equal": np.equal, "greater": np.greater, "less": np.less, "greater_or_equal": np.greater_equal, "less_or_equal": np.less_equal, "not_equal": np.not_equal}


def _mapped(m: Matrix, made: Callable[[Column], Column], keeps_zero: bool, dtype: str = "double", vector: Vector | None = None, number: Callable[[Column], Column] = d) -> Matrix:
    def applied(df: DataFrame) -> DataFrame:
        cells = df if vector is None else vector.join(df)
        return cells.select("r", "c", made(number(F.col("v"))).cast(dtype).alias("v"))

    out = applied(m.entries)
    reader = lambda rows, columns: applied(m.narrowed(rows, columns))
    if m.full or (keeps_zero and m.fill is None):
        return m.with_(entries=out, reader=reader, dtype=dtype, sparse=m.sparse and keeps_zero, p_sparse=m.p_sparse if keeps_zero else 0.0)
    fill = made(number(F.lit(0) if m.fill is None else m.fill))
    return m.with_(entries=out, reader=reader, dtype=dtype, fill=fill, vectors=m.vectors if vector is None else (*m.vectors, vector), sparse=m.sparse and keeps_zero, p_sparse=m.p_sparse if keeps_zero else 0.0)


def _one_each(rows: DataFrame, extent: int, holds: Column, check: bool) -> bool:
    """Whether a condition holds for all rows; fails unless positions 0 to extent - 1 are there once each. One small job."""
    kept = F.coalesce(F.bool_and(holds), F.lit(True))
    if not check:
        return rows.select(kept).first()[0]
    n, least, most, positions, nulls, all_ = rows.agg(F.count("*"), F.min("i"), F.max("i"), F.countDistinct("i"), F.count_if(F.greatest(*[F.col(c).isNull() for c in rows.columns])), kept).first()
    if nulls:
        raise ValueError(f"{nulls} rows of the vector's table have a null position or value")
    if n != extent or (n and (positions, least, most) != (extent, 0, extent - 1)):
        raise ValueError(f"the vector's table should have each position from 0 to {extent - 1} once; it has {n} rows, {positions} positions from {least} to {most}")
    return all_


def _as_vector(
    m: Matrix, values: Sequence[float] | DataFrame, by_row: bool, on_driver: Callable[[np.ndarray], np.ndarray], holds: Callable[..., Column],
    *, columns: Sequence[str] = ("w",), check: bool = True, dtype: str = "double",
) -> tuple[Vector, list[str], bool]:
    """Values on the driver, or rows (i, w), one for each row or column, and whether a condition holds for all of them.

    A table is validated unless `check` is false, by the same job that works the condition out.
    """
    names = [f"_{c}{next(_names)}" for c in columns]
    extent = m.nrow if by_row else m.ncol
    if isinstance(values, DataFrame):
        rows = values.select(F.col("i").cast("long").alias("i"), *[F.col(c).cast(dtype).alias(n) for c, n in zip(columns, names, strict=True)])
        return Vector(",".join(names), rows, by_row, False), names, _one_each(rows, extent, holds(*map(F.col, names)), check)  # Catalyst decides by the table's size
    number = float if dtype == "double" else int
    rows = [tuple(map(number, x)) if len(columns) > 1 else (number(x),) for x in values]
    if len(rows) != extent:
        raise ValueError(f"a vector of {len(rows)} values meets {extent} {'rows' if by_row else 'columns'}")
    schema = "i long, " + ", ".join(f"{n} {dtype}" for n in names)
    df = m.entries.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(rows)], schema)
    with np.errstate(all="ignore"):
        kept = bool(np.all(on_driver(np.asarray(values, float))))
    return Vector(",".join(names), df, by_row, len(rows) <= LISTED), names, kept


def _whole_type(m: Matrix, op: str, value: float | Sequence[float] | DataFrame, by_row: bool | None) -> str | None:
    """The type that an operation on whole numbers works in; None if it works in double."""
    own = whole.type_of(m.dtype)
    if own is None or op not in whole.EXACT:
        return None
    if by_row is None:
        return whole.promoted(own, whole.literal_type(value))
    if isinstance(value, DataFrame):
        return whole.promoted(own, whole.type_of(dict(value.dtypes)["w"]))
    return whole.promoted(own, *map(whole.literal_type, value))


def arithmetic(m: Matrix, op: str, value: float | Sequence[float] | DataFrame, *, right: bool = True, by_row: bool | None = None, check: bool = True) -> Matrix:
    """`cell op value`, or `value op cell` if not `right`. A vector (by_row given) has a value for each row or column.

    A vector may be a table (i, w); one that lacks or repeats positions, or has nulls, is an error. With `check` false it is trusted.

    Zero is kept if every value makes zero of zero; so not by multiplication with infinity, or division by zero.

    Whole numbers with whole numbers make whole numbers, exactly (see functions/whole.py), but for divide and power; all else is double.
    """
    kind = _whole_type(m, op, value, by_row)
    if kind is not None:
        return _exact(m, op, value, kind, right, by_row, check)
    f, on_driver = ieee.ARITHMETIC[op], _NUMBERS[op]
    sided = (lambda a, b: f(a, b)) if right else (lambda a, b: f(b, a))
    zero = lambda w: (on_driver(0.0, w) if right else on_driver(w, 0.0)) == 0
    if by_row is None:
        with np.errstate(all="ignore"):
            keeps = bool(zero(np.float64(value)))
        return _mapped(m, lambda v: sided(v, d(value)), keeps)
    vector, (name,), keeps = _as_vector(m, value, by_row, zero, lambda w: sided(F.lit(0.0), w) == 0, check=check)
    return _mapped(m, lambda v: sided(v, F.col(name)), keeps, vector=vector)


def _exact(m: Matrix, op: str, value: int | Sequence[int] | DataFrame, kind: str, right: bool, by_row: bool | None, check: bool) -> Matrix:
    """arithmetic() of whole numbers in one type."""
    f = whole.EXACT[op]
    sided = (lambda a, b: f(a, b)) if right else (lambda a, b: f(b, a))
    number = lambda x: x.cast(kind)
    if op == "multiply":
        zero = lambda w: w == w
    elif op in ("add", "subtract"):
        zero = lambda w: w == 0
    else:
        zero = lambda w: w != 0 if right else w != w
    if by_row is None:
        return _mapped(m, lambda v: sided(v, F.lit(value).cast(kind)), bool(zero(value)), kind, number=number)
    vector, (name,), keeps = _as_vector(m, value, by_row, zero, zero, check=check, dtype=kind)
    return _mapped(m, lambda v: sided(v, F.col(name)), keeps, kind, vector, number)


def compare(m: Matrix, op: str, value: float | Sequence[float] | DataFrame, *, by_row: bool | None = None, dtype: str = "double", check: bool = True) -> Matrix:
    """1 where the comparison holds, else 0; NaN equals nothing. Zero is kept if the comparison fails for it."""
    f, on_driver = ieee.COMPARE[op], _COMPARED[op]
    if by_row is None:
        return _mapped(m, lambda v: f(v, d(value)).cast("double"), not on_driver(0.0, value), dtype)
    vector, (name,), keeps = _as_vector(m, value, by_row, lambda w: ~on_driver(0.0, w), lambda w: ~f(F.lit(0.0), w), check=check)
    return _mapped(m, lambda v: f(v, F.col(name)).cast("double"), keeps, dtype, vector)


def special_compare(m: Matrix, test: str, *, passes: bool = True, dtype: str = "double") -> Matrix:
    """isnan, isinf or isfinite as 1 and 0; reversed unless `passes`."""
    f = ieee.SPECIAL[test]
    return _mapped(m, lambda v: (f(v) if passes else ~f(v)).cast("double"), (test != "isfinite") == passes, dtype)


def boolean(m: Matrix, op: str, value: bool | Sequence[bool] | DataFrame, *, by_row: bool | None = None, dtype: str = "double", check: bool = True) -> Matrix:
    """and, or, xor, equal on truth values; whatever isn't zero, NaN included, is true."""
    f = ieee.BOOLEAN[op]
    keeps_for = {"and": lambda b: b | True, "or": lambda b: ~b, "xor": lambda b: ~b, "equal": lambda b: b | False}[op]
    if by_row is None:
        b = bool(value) or value != value
        return _mapped(m, lambda v: f(v, d(float(b))).cast("double"), bool(keeps_for(np.bool_(b))), dtype)
    vector, (name,), keeps = _as_vector(m, value, by_row, lambda w: keeps_for((w != 0)), lambda w: ieee.truth(w) if op == "equal" else ~ieee.truth(w), check=check)
    return _mapped(m, lambda v: f(v, F.col(name)).cast("double"), keeps or op == "and", dtype, vector)


def boolean_not(m: Matrix, dtype: str = "double") -> Matrix:
    return _mapped(m, lambda v: (~ieee.truth(v)).cast("double"), False, dtype)


def boolean_cast(m: Matrix, dtype: str = "double") -> Matrix:
    return _mapped(m, lambda v: ieee.truth(v).cast("double"), True, dtype)


def math_function(m: Matrix, name: str, base: float | None = None, dtype: str = "double") -> Matrix:
    """A function of ieee.MATH, or `log` to a base."""
    if name == "log" and base is not None:
        return _mapped(m, lambda v: ieee.divide(ieee.ln(v), d(math.log(base))), False, dtype)
    f, keeps = ieee.MATH[name]
    return _mapped(m, f, keeps, dtype)


def substitute(m: Matrix, op: str, compared, substitute_=None, *, by_row: bool | None = None, check: bool = True) -> Matrix:
    """Cells that compare so with `compared` become the substitute.

    By row or column, `compared` is a sequence as long as `substitute_`, or one table (i, compared, substitute).
    Zero is kept if it doesn't compare so, or its substitute is zero.
    """
    f, on_driver = ieee.COMPARE[op], _COMPARED[op]
    if by_row is None:
        keeps = not on_driver(0.0, compared) or substitute_ == 0
        return _mapped(m, lambda v: F.when(f(v, d(compared)), d(substitute_)).otherwise(v), bool(keeps))
    if isinstance(compared, DataFrame):
        pairs = compared
    else:
        if len(compared) != len(substitute_):
            raise ValueError("lengths of the compared and substitute vectors should be the same")
        pairs = np.column_stack([np.asarray(compared, float), np.asarray(substitute_, float)])
    sound = lambda w: ~on_driver(0.0, w[:, 0]) | (w[:, 1] == 0) if len(w) else np.ones(0, bool)
    vector, (with_, to), keeps = _as_vector(m, pairs, by_row, sound, lambda a, b: ~f(F.lit(0.0), a) | (b == 0), columns=("compared", "substitute"), check=check)
    return _mapped(m, lambda v: F.when(f(v, F.col(with_)), F.col(to)).otherwise(v), keeps, vector=vector)


def substitute_special(m: Matrix, test: str, substitute_: float, *, passes: bool = True) -> Matrix:
    """Cells that are (or, unless `passes`, are not) NaN, infinite or finite become the substitute."""
    f = ieee.SPECIAL[test]
    keeps = (test != "isfinite") == passes or substitute_ == 0
    return _mapped(m, lambda v: F.when(f(v) if passes else ~f(v), d(substitute_)).otherwise(v), keeps)


@dataclass(frozen=True)
class Helper:
    """A custom operation: `expr(v, r, c)` is a column; functions/arrays.py makes one of a function of NumPy arrays.
    Set `nrow` or `ncol` where it fits only such matrices.

    `depends_on_row` and `depends_on_column` tell what it makes of zero; of other cells it may always use the position.
    If it depends on one of them, absent cells stay absent and get a fill for each row or column; if on both, it is applied to all cells.
    """

    expr: Callable[[Column, Column, Column], Column]
    keeps_zero: bool = False
    depends_on_row: bool = False
    depends_on_column: bool = False
    nrow: int | None = None
    ncol: int | None = None


def custom(m: Matrix, helper: Helper, dtype: str = "double") -> Matrix:
    if helper.nrow not in (None, m.nrow) or helper.ncol not in (None, m.ncol):
        raise ValueError("dimensions of the matrix and the helper should be the same")
    depends = {b for b, on in ((True, helper.depends_on_row), (False, helper.depends_on_column)) if on} | {v.by_row for v in m.vectors}
    if not helper.keeps_zero and not m.full and (helper.depends_on_row or helper.depends_on_column):
        if len(depends) > 1:
            m = m.with_(entries=m.cells(), full=True, fill=None, vectors=(), sparse=False, p_sparse=0.0)
        else:
            return _filled_by_line(m, helper, helper.depends_on_row, dtype)
    return _mapped(m, lambda v: helper.expr(v, F.col("r"), F.col("c")), helper.keeps_zero, dtype)


def _filled_by_line(m: Matrix, helper: Helper, by_row: bool, dtype: str) -> Matrix:
    """custom() whose result for absent cells differs by row, or by column, alone: one value for each."""
    name, p = f"_custom{next(_names)}", "r" if by_row else "c"
    lines = m.entries.sparkSession.range(m.nrow if by_row else m.ncol).select(F.col("id").alias(p))
    for vector in m.vectors:
        lines = vector.join(lines)
    none = F.lit(0).cast("long")  # whatever it is there, it makes no difference
    zero = d(F.lit(0.0) if m.fill is None else m.fill)
    value = helper.expr(zero, F.col(p) if by_row else none, none if by_row else F.col(p))
    lines = lines.select(F.col(p).alias("i"), value.cast(dtype).alias(name))

    def applied(df: DataFrame) -> DataFrame:
        return df.select("r", "c", helper.expr(d(F.col("v")), F.col("r"), F.col("c")).cast(dtype).alias("v"))

    reader = lambda rows, columns: applied(m.narrowed(rows, columns))
    return m.with_(entries=applied(m.entries), reader=reader, dtype=dtype, fill=F.col(name), vectors=(Vector(name, lines, by_row, False),), sparse=False, p_sparse=0.0)
