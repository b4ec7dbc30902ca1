"""Selected positions of one dimension, and how they reach a scan."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import LISTED

#: Runs of consecutive positions that a scan gets as ranges.
RANGES = 64


def consecutive_runs(indices: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(start, length) of each run of a sorted list."""
    start = length = 0
    for x in indices:
        if length and x == start + length:
            length += 1
            continue
        if length:
            yield start, length
        start, length = x, 1
    if length:
        yield start, length


@dataclass(frozen=True)
class Selection:
    """Positions of one dimension: start and length, or a strictly increasing list."""

    start: int
    length: int
    listed: tuple[int, ...] | None = None

    @staticmethod
    def of(given, extent: int) -> Selection:
        if given is None:
            return Selection(0, extent)
        if isinstance(given, Selection):
            return given
        if isinstance(given, tuple):
            start, length = given
            if start < 0 or length < 0 or start + length > extent:
                raise IndexError(f"the block from {start}, of {length} positions, goes beyond the extent {extent}")
            return Selection(start, length)
        listed = tuple(int(x) for x in given)
        if any(b <= a for a, b in zip(listed, listed[1:], strict=False)):
            raise ValueError("the positions should be unique and sorted")
        if listed and (listed[0] < 0 or listed[-1] >= extent):
            raise IndexError("a position goes beyond the extent")
        if len(listed) > LISTED:
            raise ValueError(f"more than {LISTED} listed positions; use subset() with a table of them")
        return Selection.listing(listed)

    @staticmethod
    def listing(listed: tuple[int, ...]) -> Selection:
        """Sorted positions; consecutive ones are a block."""
        if listed and listed[-1] - listed[0] == len(listed) - 1:
            return Selection(listed[0], len(listed))
        return Selection(0, len(listed), listed)

    def position(self, k: Column) -> Column:
        """The k-th position selected."""
        if self.listed is None:
            return k + F.lit(self.start).cast("long")
        return F.element_at(F.expr(f"cast(split('{','.join(map(str, self.listed))}', ',') as array<bigint>)"), (k + 1).cast("int"))

    def runs(self) -> list[tuple[int, int]]:
        """(start, length) of each run of consecutive positions."""
        return list(consecutive_runs(self.listed)) if self.listed is not None else [(self.start, self.length)] * (self.length > 0)

    def within(self, start: int, length: int) -> Selection:
        """What is selected of `length` positions from `start` on, counted from there."""
        if self.listed is None:
            a, b = max(self.start, start), min(self.start + self.length, start + length)
            return Selection(max(0, a - start), max(0, b - a))
        a, b = bisect_left(self.listed, start), bisect_left(self.listed, start + length)
        return Selection.listing(tuple(x - start for x in self.listed[a:b]))

    def moved(self, by: int) -> Selection:
        return Selection(self.start + by, self.length) if self.listed is None else Selection(0, self.length, tuple(x + by for x in self.listed))

    def grouped(self, size: int) -> Selection:
        """The groups of `size` positions that have a selected one."""
        if self.listed is None:
            first = self.start // size
            return Selection(first, (self.start + self.length - 1) // size - first + 1 if self.length else 0)
        return Selection.listing(tuple(sorted({x // size for x in self.listed})))

    def keep(self, df: DataFrame, name: str, extent: int) -> DataFrame:
        """Rows whose position is selected. Runs become ranges, which reach a Parquet scan; of more than RANGES runs the range from
        the least to the greatest position does, and the positions themselves, LISTED at most, meet the rows by broadcast."""
        if self.listed is None and (self.start, self.length) == (0, extent):
            return df
        p, runs = F.col(name), self.runs()
        if len(runs) <= RANGES:
            return df.where(reduce(or_, [(p >= a) & (p < a + n) for a, n in runs], F.lit(False)))
        near = df.where((p >= self.listed[0]) & (p <= self.listed[-1]))
        wanted = df.sparkSession.range(len(self.listed)).select(self.position(F.col("id")).alias(name))
        return near.join(F.broadcast(wanted), name, "left_semi")


def every(extent: int) -> Selection:
    return Selection(0, extent)
