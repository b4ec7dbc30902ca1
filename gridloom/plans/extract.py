"""Reading rows or columns: whole, a block or listed positions of the other dimension, in any order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..matrix import LISTED, Matrix
from .selection import Selection, consecutive_runs


#: Positions of a line that one row of arrays holds at most.
STRETCH = 65_536


def stretches(m: Matrix, own: DataFrame, by_row: bool, lines: Selection, block: Selection) -> DataFrame:
    """(p, b, x): the cells of line p (a row, or a column) from place b * STRETCH of `block` on, null where there is no entry.

    Only entries are shuffled, and a row for each line and stretch; absent cells are made inside the arrays.
    """
    o, i = ("r", "c") if by_row else ("c", "r")
    at = F.col(i) - F.lit(block.start).cast("long")
    b = F.expr(f"({i} - {block.start}L) div {STRETCH}L")
    packed = own.select(F.col(o).alias("p"), b.alias("b"), F.struct((at % STRETCH).cast("int").alias("s"), "v").alias("e")).groupBy("p", "b").agg(F.array_sort(F.collect_list("e")).alias("e"))
    parts = max(1, -(-block.length // STRETCH))
    every = own.sparkSession.range(lines.length * parts if block.length else 0).select(lines.position(F.expr(f"id div {parts}L")).alias("p"), F.expr(f"id % {parts}L").alias("b"))
    none = F.lit(None).cast(m.dtype)
    size = F.least(F.lit(STRETCH), F.lit(block.length).cast("long") - F.col("b") * STRETCH).cast("int")
    before = F.concat(F.array(F.lit(-1)), F.col("e.s"))
    filled = F.flatten(F.zip_with("e", F.slice(before, F.lit(1), F.size("e")), lambda e, last: F.concat(F.array_repeat(none, e["s"] - last - 1), F.array(e["v"]))))
    rest = size - F.element_at("e", -1)["s"] - 1
    x = F.when(F.col("e").isNull(), F.array_repeat(none, size)).otherwise(F.concat(filled, F.array_repeat(none, rest)))
    return every.join(packed, ["p", "b"], "left").select("p", "b", x.alias("x"))


def filled_stretches(m: Matrix, own: DataFrame, by_row: bool, lines: Selection, block: Selection) -> DataFrame:
    """stretches() with the absent cells filled where the fill depends on the lines alone, or on the positions along them alone.

    It is then joined by line, or zipped as arrays by stretch, and never by cell.
    """
    found = stretches(m, own, by_row, lines, block)
    o, i = ("r", "c") if by_row else ("c", "r")
    if by_line(m, by_row):
        found = found.withColumnRenamed("p", o)
        for vector in m.vectors:
            found = vector.join(found)
        found = found.select(F.col(o).alias("p"), "b", "x", fill_of(m).alias("fill"))
        return found.select("p", "b", F.transform("x", lambda v: F.coalesce(v, F.col("fill"))).alias("x"))
    places = own.sparkSession.range(block.length).select(block.position(F.col("id")).alias(i))
    for vector in m.vectors:
        places = vector.join(places)
    places = places.select((F.col(i) - F.lit(block.start).cast("long")).alias("s"), fill_of(m).alias("v"))
    packed = places.groupBy(F.expr(f"s div {STRETCH}L").alias("b")).agg(F.array_sort(F.collect_list(F.struct("s", "v"))).alias("f"))
    packed = packed.select("b", F.col("f.v").alias("f"))
    found = found.join(F.broadcast(packed) if block.length <= LISTED else packed, "b")
    return found.select("p", "b", F.zip_with("x", "f", lambda v, f: F.coalesce(v, f)).alias("x"))


def fill_of(m: Matrix) -> Column:
    return (F.lit(0.0) if m.fill is None else m.fill).cast(m.dtype)


def cells(m: Matrix, rows=None, columns=None) -> DataFrame:
    """(r, c, v) for every selected cell, absent ones filled.

    Lines run along the shorter dimension of the selection, or along the other one if that is a list of positions.
    Of two lists the grid is made from one range and meets the entries in an aggregation; its size is that of the selection.
    """
    rows, columns = Selection.of(rows, m.nrow), Selection.of(columns, m.ncol)
    own = m.narrowed(rows, columns).select("r", "c", "v")
    if m.full:
        return own
    if rows.listed is not None and columns.listed is not None:
        n, width = rows.length * columns.length, max(1, columns.length)
        grid = own.sparkSession.range(n).select(rows.position(F.expr(f"id div {width}L")).alias("r"), columns.position(F.expr(f"id % {width}L")).alias("c"), F.lit(None).cast(m.dtype).alias("v"))
        met = own.union(grid).groupBy("r", "c").agg(F.max("v").alias("v"))
    else:
        by_row = columns.listed is None and (rows.listed is not None or columns.length <= rows.length)
        lines, block = (rows, columns) if by_row else (columns, rows)
        apart = by_line(m, True) or by_line(m, False)
        # the outer form, as the inner one has the arrays worked out once more to leave empty ones out
        met = (filled_stretches if apart else stretches)(m, own, by_row, lines, block).select("p", "b", F.posexplode_outer("x").alias("s", "v")).where("s is not null")
        at = F.col("b") * STRETCH + F.col("s") + F.lit(block.start).cast("long")
        met = met.select(*([F.col("p").alias("r"), at.alias("c")] if by_row else [at.alias("r"), F.col("p").alias("c")]), "v")
        if apart:
            return met.select("r", "c", "v")
    for vector in m.vectors:
        met = vector.join(met)
    return met.select("r", "c", F.coalesce("v", fill_of(m)).alias("v"))


def by_line(m: Matrix, row: bool) -> bool:
    """The fill of a row's (or column's) absent cells depends on nothing else."""
    return all(v.by_row == row for v in m.vectors)


def entries(m: Matrix, rows=None, columns=None) -> DataFrame:
    """(r, c, v) for the structural entries selected; of a matrix with filled cells every cell is structural."""
    if not m.structural():
        return cells(m, rows, columns)
    return m.narrowed(Selection.of(rows, m.nrow), Selection.of(columns, m.ncol)).select("r", "c", "v")


@dataclass(frozen=True)
class ConsecutiveOracle:
    """Positions from `start` on, one after another."""

    start: int
    length: int

    def total(self) -> int:
        return self.length

    def get(self, i: int) -> int:
        return self.start + i


@dataclass(frozen=True)
class FixedOracle:
    """Positions in any order; repeated ones are read repeatedly."""

    positions: Sequence[int]

    def total(self) -> int:
        return len(self.positions)

    def get(self, i: int) -> int:
        return self.positions[i]


def extract(
    m: Matrix,
    target: str,
    form: str,
    selection=None,
    *,
    oracle=None,
    at=None,
    sparse_extract_index: bool = True,
    sparse_extract_value: bool = True,
    sparse_ordered_index: bool = True,
) -> DataFrame:
    """Each row or column of `target`, with positions of the other dimension restricted by `selection`.

    Dense: (i, x). Sparse: (i, number, index, value) with original positions; index and value may be
    left out, number is the same then. `at` restricts the targets (position, block or list). An oracle,
    or a DataFrame (step, index), gives rows by step, repeated targets repeatedly.
    """
    extent, other = (m.nrow, m.ncol) if target == "row" else (m.ncol, m.nrow)
    t, o = ("r", "c") if target == "row" else ("c", "r")
    steps = None
    if isinstance(oracle, ConsecutiveOracle):
        at = (oracle.start, oracle.length)
        Selection.of(at, extent)
    elif isinstance(oracle, DataFrame):
        steps = oracle
    elif oracle is not None:
        wanted = [int(oracle.get(k)) for k in range(oracle.total())]
        at = sorted(set(wanted))
        steps = m.entries.sparkSession.createDataFrame(list(enumerate(wanted)), "step long, index long")
    if isinstance(at, int):
        at = (at, 1)
    at, chosen = Selection.of(at, extent), Selection.of(selection, other)
    rows, columns = (at, chosen) if target == "row" else (chosen, at)
    spark = m.entries.sparkSession
    inside = form == "dense" and not m.full and chosen.listed is None and chosen.length <= STRETCH and (by_line(m, True) or by_line(m, False))
    found = None if inside else cells(m, rows, columns) if form == "dense" else entries(m, rows, columns)
    every = spark.range(at.length).select(at.position(F.col("id")).alias("i"))
    typed = f"array<{m.dtype}>"
    if inside:  # absent cells are filled where the arrays are made
        own = m.narrowed(rows, columns).select("r", "c", "v")
        lines = filled_stretches(m, own, target == "row", at, chosen).select(F.col("p").alias("i"), F.col("x").alias("y"))
        out = every.join(lines, "i", "left") if chosen.length == 0 else lines
        out = out.select("i", F.coalesce("y", F.array().cast(typed)).alias("x"))
    elif form == "dense":
        packed = found.groupBy(F.col(t).alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col(o).alias("s"), "v"))).alias("e"))
        out = every.join(packed, "i", "left").select("i", F.coalesce("e.v", F.array().cast(typed)).alias("x"))
    else:
        kept = [F.col(o).alias("s")] * (sparse_extract_index or sparse_ordered_index) + [F.col("v")] * sparse_extract_value
        listed = F.collect_list(F.struct(*kept)) if kept else None
        aggs = [F.count("*").alias("number")] + ([(F.array_sort(listed) if sparse_ordered_index else listed).alias("e")] if kept and (sparse_extract_index or sparse_extract_value) else [])
        packed = every.join(found.groupBy(F.col(t).alias("i")).agg(*aggs), "i", "left")
        shown = [F.coalesce("number", F.lit(0).cast("long")).alias("number")]
        if sparse_extract_index:
            shown.append(F.coalesce("e.s", F.array().cast("array<bigint>")).alias("index"))
        if sparse_extract_value:
            shown.append(F.coalesce("e.v", F.array().cast(typed)).alias("value"))
        out = packed.select("i", *shown)
    if isinstance(oracle, ConsecutiveOracle):
        return out.select((F.col("i") - oracle.start).alias("step"), *out.columns)
    if steps is not None:
        return steps.select("step", F.col("index").alias("i")).join(out, "i").select("step", *out.columns)
    return out


def consecutive(m: Matrix, row: bool, form: str, start: int, length: int, selection=None, **options) -> DataFrame:
    return extract(m, "row" if row else "column", form, selection, oracle=ConsecutiveOracle(start, length), **options)


def process_consecutive_indices(indices: Sequence[int], fun: Callable[[int, int], None]) -> None:
    """Calls fun(start, length) for each run of a sorted list."""
    for start, length in consecutive_runs(indices):
        fun(start, length)


def fetch(m: Matrix, row: bool, i: int, form: str = "dense", selection=None, **options) -> DataFrame:
    """One row or column."""
    return extract(m, "row" if row else "column", form, selection, at=i, **options)


def deliver(m: Matrix, row: bool, oracle, form: str = "dense", selection=None, *, ahead: int = 1024, **options) -> Iterator[Row]:
    """The reads of an oracle, or of a table (step, index), one after another in the order of their steps.

    The client holds the reads of about 2 * `ahead` steps at most: steps are put into ranges of that many, one of which is
    read while the next one is fetched. Steps of a table should be distinct; those whose position doesn't exist are left out.
    """
    found = extract(m, "row" if row else "column", form, selection, oracle=oracle, **options)
    total = oracle.count() if isinstance(oracle, DataFrame) else oracle.total()
    ranged = found.repartitionByRange(max(1, -(-total // max(1, ahead))), "step").sortWithinPartitions("step")
    return ranged.toLocalIterator(prefetchPartitions=True)
