"""Custom operations as functions of NumPy arrays.

Such a function sees one Arrow batch of cells at a time, so it costs no call a cell. It becomes a column expression,
which the helpers of unary.custom() and binary.combine() take.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(fun: Callable[..., np.ndarray], cells: list[Column], positions: list[Column]) -> Column:
    """fun() of doubles and of whole positions; NaN stays NaN on both ways, though it travels as null."""
    n = len(cells)

    def batch(*given: pd.Series) -> pd.Series:
        numbers = [s.to_numpy(dtype=float, na_value=math.nan) for s in given[:n]]
        return pd.Series(np.asarray(fun(*numbers, *[s.to_numpy() for s in given[n:]]), float))

    def one(a: pd.Series) -> pd.Series:
        return batch(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return batch(a, b, c)

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return batch(a, b, c, d)

    made = F.pandas_udf([one, two, three, four][n + len(positions) - 1], "double")
    return F.coalesce(made(*cells, *positions), F.lit(math.nan))


def of_cells(fun: Callable[..., np.ndarray], *, row: bool = False, column: bool = False) -> Callable[[Column, Column, Column], Column]:
    """`expr` of a unary.Helper: fun(values), followed by the cells' rows and columns where it asks for them."""
    return lambda v, r, c: _column(fun, [v], [r] * row + [c] * column)


def of_pairs(fun: Callable[..., np.ndarray], *, row: bool = False, column: bool = False) -> Callable[[Column, Column, Column, Column], Column]:
    """`expr` of a binary.BinaryHelper: fun(left, right), followed by the cells' rows and columns where it asks for them."""
    return lambda a, b, r, c: _column(fun, [a, b], [r] * row + [c] * column)
