"""Materialised forms: dense arrays, list-of-lists, compressed contents, counts, sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import Matrix
from .extract import STRETCH, by_line, cells, entries, extract, fill_of
from .prefix import running_total


def to_dense(m: Matrix, row_major: bool = True, dtype: str | None = None, num_threads: int = 1) -> DataFrame:
    """(i, x): an array for each row or column. The number of threads is accepted and has no effect."""
    out = extract(m, "row" if row_major else "column", "dense")
    return out if dtype is None else out.withColumn("x", F.col("x").cast(f"array<{dtype}>"))


def convert_to_dense(m: Matrix, row_major: bool = True, dtype: str = "double", num_threads: int = 1) -> Matrix:
    """Every cell an entry; entries are not gathered by row or column for that."""
    found = cells(m).select("r", "c", F.col("v").cast(dtype).alias("v"))
    return Matrix(found, m.nrow, m.ncol, sparse=False, full=True, p_sparse=0.0, p_rows=1.0 if row_major else 0.0, dtype=dtype)


def _stored(m: Matrix, row: bool) -> DataFrame:
    """Entries that a sparse form stores: those of a sparse matrix as they are, of others what isn't zero (NaN is not)."""
    found = entries(m) if m.sparse else cells(m).where(F.isnan(F.col("v").cast("double")) | (F.col("v") != 0))
    return found.select(F.col("r" if row else "c").alias("p"), F.col("c" if row else "r").alias("s"), "v")


def fragmented_contents(m: Matrix, row: bool = True, num_threads: int = 1) -> DataFrame:
    """(i, index, value) for every row or column."""
    grouped = _stored(m, row).groupBy(F.col("p").alias("i")).agg(F.array_sort(F.collect_list(F.struct("s", "v"))).alias("e"))
    every = m.entries.sparkSession.range(m.nrow if row else m.ncol).withColumnRenamed("id", "i")
    return every.join(grouped, "i", "left").select("i", F.coalesce("e.s", F.array().cast("array<bigint>")).alias("index"), F.coalesce("e.v", F.array().cast(f"array<{m.dtype}>")).alias("value"))


def _sparse(m: Matrix, row: bool) -> Matrix:
    p, s = ("r", "c") if row else ("c", "r")
    found = _stored(m, row).select(F.col("p").alias(p), F.col("s").alias(s), "v").select("r", "c", "v")
    return Matrix(found, m.nrow, m.ncol, p_rows=1.0 if row else 0.0, dtype=m.dtype)


def convert_to_fragmented(m: Matrix, row: bool = True, num_threads: int = 1) -> Matrix:
    """What a sparse form stores, as entries; nothing is gathered by row or column."""
    return _sparse(m, row)


def compressed_contents(m: Matrix, row: bool = True, two_pass: bool = False, num_threads: int = 1) -> DataFrame:
    """(i, index, value, pointer): contents by row or column, and where each ends in the flat arrays. Passes and threads have no effect."""
    out = fragmented_contents(m, row).withColumn("n", F.size("index").cast("long"))
    return running_total(out, "n").select("i", "index", "value", F.col("total").alias("pointer"))


def convert_to_compressed(m: Matrix, row: bool = True, two_pass: bool = False, num_threads: int = 1) -> Matrix:
    return _sparse(m, row)


def _every(m: Matrix, row: bool) -> tuple[DataFrame, int]:
    """(i) for every row or column, and how many cells each has."""
    return m.entries.sparkSession.range(m.nrow if row else m.ncol).withColumnRenamed("id", "i"), m.ncol if row else m.nrow


def _with_fill(m: Matrix, row: bool, aggs: list) -> DataFrame:
    """(i, n, absent, fill) and the aggregates of its entries for every row or column; `fill` is the value of its absent cells."""
    every, width = _every(m, row)
    counts = m.entries.groupBy(F.col("r" if row else "c").alias("i")).agg(F.count("*").alias("n"), *aggs)
    rows = every.join(counts, "i", "left").withColumn("absent", F.lit(width).cast("long") - F.coalesce("n", F.lit(0))).withColumnRenamed("i", "r" if row else "c")
    for vector in m.vectors:
        rows = vector.join(rows)
    return rows.withColumn("fill", fill_of(m).cast("double")).withColumnRenamed("r" if row else "c", "i")


def count_non_zeros(m: Matrix, row: bool = True) -> DataFrame:
    """(i, n): stored entries of each row or column; for a matrix that isn't sparse, cells that aren't zero.

    Absent cells are counted, not made, if a row's (or column's) have one value.
    """
    if not m.sparse and not m.full and by_line(m, row):
        v = F.col("v").cast("double")
        rows = _with_fill(m, row, [F.count_if(F.isnan(v) | (v != 0)).alias("own")])
        filled = F.when(F.isnan("fill") | (F.col("fill") != 0), F.col("absent")).otherwise(F.lit(0))
        return rows.select("i", (F.coalesce("own", F.lit(0)) + filled).alias("n"))
    counts = _stored(m, row).groupBy(F.col("p").alias("i")).agg(F.count("*").alias("n"))
    return _every(m, row)[0].join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def stretch_counts(m: Matrix, row: bool = True) -> DataFrame:
    """(p, b, n): how many entries a sparse form stores of row (or column) p in its b-th stretch."""
    return _stored(m, row).groupBy("p", F.expr(f"s div {STRETCH}L").alias("b")).agg(F.count("*").alias("n"))


def pointers_of(sizes: DataFrame, extent: int) -> DataFrame:
    """(i, n, total) of every row (or column) from its stretch_counts(): its entries, and those up to its end."""
    every = sizes.sparkSession.range(extent).withColumnRenamed("id", "i")
    counts = every.join(sizes.groupBy(F.col("p").alias("i")).agg(F.sum("n").alias("n")), "i", "left").select("i", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return running_total(counts, "n")


def fill_compressed(m: Matrix, row: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """(p, s, v, k): the stored entries with their place in the flat arrays.

    An entry's place is the number of entries of earlier rows (or columns), of earlier stretches of its own, and
    before it in its stretch, so no row is gathered and none is sorted as a whole. `sizes` are the stretch_counts()
    if an earlier pass has written them; else they are counted here.
    """
    stored = _stored(m, row).withColumn("b", F.expr(f"s div {STRETCH}L"))
    if sizes is None:
        sizes = stretch_counts(m, row)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = pointers_of(sizes, m.nrow if row else m.ncol).select(F.col("i").alias("p"), (F.col("total") - F.col("n")).alias("first"))
    heads = sizes.withColumn("earlier", earlier).join(firsts, "p").select("p", "b", (F.col("first") + F.col("earlier")).alias("head"))
    place = F.row_number().over(Window.partitionBy("p", "b").orderBy("s")) - 1
    return stored.withColumn("place", place).join(heads, ["p", "b"]).select("p", "s", "v", (F.col("head") + F.col("place")).alias("k"))


def sums(m: Matrix, row: bool = True) -> DataFrame:
    """(i, total) by row or column. Absent cells are not made if those of a row (or column) have one value, which counts as often as there are."""
    if not m.full and by_line(m, row):
        rows = _with_fill(m, row, [F.sum(F.col("v").cast("double")).alias("own")])
        filled = F.when(F.col("absent") > 0, F.col("fill") * F.col("absent")).otherwise(F.lit(0.0))
        return rows.select("i", (F.coalesce("own", F.lit(0.0)) + filled).alias("total"))
    counts = cells(m).groupBy(F.col("r" if row else "c").alias("i")).agg(F.sum(F.col("v").cast("double")).alias("total"))
    return _every(m, row)[0].join(counts, "i", "left").select("i", F.coalesce("total", F.lit(0.0)).alias("total"))


def row_sums(m: Matrix) -> DataFrame:
    return sums(m, True)


def col_sums(m: Matrix) -> DataFrame:
    return sums(m, False)
