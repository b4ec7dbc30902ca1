"""The matrix: entries as (r, c, v) rows, and what the plan knows without running it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .plans.selection import Selection

#: Driver-side position lists up to this length may be broadcast or turned into literals.
LISTED = 1_000_000


@dataclass(frozen=True)
class Vector:
    """A value for each row (by_row) or column: (i, `name`). It is sent to all tasks only if its length is known to be small."""

    name: str
    rows: DataFrame
    by_row: bool
    small: bool

    def join(self, cells: DataFrame) -> DataFrame:
        rows = self.rows.withColumnRenamed("i", "r" if self.by_row else "c")
        return cells.join(F.broadcast(rows) if self.small else rows, "r" if self.by_row else "c")


@dataclass(frozen=True)
class Matrix:
    """Positions are 0-based and unique; `fill` is the value of absent cells, None for zero.

    `full` says that every cell has an entry. A fill may name the columns of `vectors`, which are
    joined only when absent cells are read, so no operation makes absent cells before an extraction.
    Entries with an explicit zero are structural and stay so.
    """

    entries: DataFrame
    nrow: int
    ncol: int
    sparse: bool = True
    full: bool = False
    fill: Column | None = None
    vectors: tuple[Vector, ...] = field(default=())
    p_sparse: float = 1.0
    p_rows: float = 1.0
    dtype: str = "double"
    #: How entries of selected rows and columns are read without the others; None: by their positions.
    reader: Callable[[Selection, Selection], DataFrame] | None = field(default=None, compare=False)

    def is_sparse(self) -> bool:
        return self.sparse

    def is_sparse_proportion(self) -> float:
        return self.p_sparse

    def prefer_rows(self) -> bool:
        return self.p_rows > 0.5

    def prefer_rows_proportion(self) -> float:
        return self.p_rows

    def uses_oracle(self, row: bool) -> bool:
        """Predictions of the access order don't change a Spark plan."""
        return False

    def structural(self) -> bool:
        """A sparse read returns the entries alone."""
        return self.full or self.fill is None

    def with_(self, **changes) -> Matrix:
        """Changed; entries that are replaced have another reader, or none."""
        return replace(self, **({"reader": None} if "entries" in changes else {}) | changes)

    def narrowed(self, rows: Selection, columns: Selection) -> DataFrame:
        """The entries of selected rows and columns, at their positions in the whole matrix."""
        if self.reader is not None:
            return self.reader(rows, columns)
        return columns.keep(rows.keep(self.entries, "r", self.nrow), "c", self.ncol)

    def _extract(self, target: str, form: str, args: tuple, options: dict) -> DataFrame:
        from .plans.extract import extract

        selection = args[0] if len(args) == 1 else (args if args else None)
        return extract(self, target, form, selection, **options)

    def dense_row(self, *selection, **options) -> DataFrame:
        """Rows as arrays; selection: nothing, (start, length) or a sorted list of columns. See extract()."""
        return self._extract("row", "dense", selection, options)

    def dense_column(self, *selection, **options) -> DataFrame:
        return self._extract("column", "dense", selection, options)

    def sparse_row(self, *selection, **options) -> DataFrame:
        return self._extract("row", "sparse", selection, options)

    def sparse_column(self, *selection, **options) -> DataFrame:
        return self._extract("column", "sparse", selection, options)

    def dense(self, row: bool, *selection, **options) -> DataFrame:
        return self._extract("row" if row else "column", "dense", selection, options)

    def sparse_read(self, row: bool, *selection, **options) -> DataFrame:
        return self._extract("row" if row else "column", "sparse", selection, options)

    def cells(self, rows=None, columns=None) -> DataFrame:
        from .plans.extract import cells

        return cells(self, rows, columns)
