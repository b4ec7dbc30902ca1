"""Leaf matrices. `check` runs one validating job; without it the contents are trusted."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..plans.prefix import running_total
from ..scratch import shared_folder


def _fail_if(rows: DataFrame, message: str) -> None:
    """Raises the message, with the first offending row, if there is one."""
    found = rows.first()
    if found is not None:
        raise ValueError(f"{message}, not as in {found.asDict()}")


def _typed(v: Column, dtype: str) -> Column:
    return v.cast(dtype)


def from_coo(df: DataFrame, nrow: int, ncol: int, *, check: bool = False, combine: str | None = None, csr: bool = True, dtype: str = "double") -> Matrix:
    """A sparse matrix from rows (r, c, v). `combine="sum"` adds up repeated positions; otherwise they are an error."""
    df = df.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), _typed(F.col("v"), dtype).alias("v"))
    if combine == "sum":
        df = df.groupBy("r", "c").agg(F.sum("v").alias("v"))
    if check:
        _fail_if(df.where("r is null or c is null or v is null"), "positions and values may not be null")
        _fail_if(df.where(~F.col("r").between(0, nrow - 1) | ~F.col("c").between(0, ncol - 1)), "a position should not be negative and be less than the extent")
        if combine is None:
            _fail_if(df.groupBy("r", "c").count().where("count > 1"), "positions should come once each, their indices strictly increasing")
    return Matrix(df, nrow, ncol, p_rows=1.0 if csr else 0.0, dtype=dtype)


def from_rows(df: DataFrame, nrow: int, ncol: int, *, row_major: bool = True, check: bool = True, dtype: str = "double") -> Matrix:
    """A dense matrix from (i, x): an array for each row (row_major) or column."""
    if check:
        most, width = (nrow, ncol) if row_major else (ncol, nrow)
        _fail_if(df.where(F.col("i").isNull() | F.col("x").isNull() | (F.size("x") != width) | ~F.col("i").between(0, most - 1)), "there should be as many values as the product of the extents")
        if df.select(F.countDistinct("i"), F.count("*")).first() != (most, most):
            raise ValueError("there should be as many values as the product of the extents")
    long = df.select(F.col("i").cast("long").alias("p"), F.posexplode("x").alias("s", "v")).select("p", F.col("s").cast("long").alias("s"), _typed(F.col("v"), dtype).alias("v"))
    r, c = ("p", "s") if row_major else ("s", "p")
    return Matrix(long.select(F.col(r).alias("r"), F.col(c).alias("c"), "v"), nrow, ncol, sparse=False, full=True, p_sparse=0.0, p_rows=1.0 if row_major else 0.0, dtype=dtype)


def from_flat(df: DataFrame, nrow: int, ncol: int, *, row_major: bool = True, check: bool = True, dtype: str = "double") -> Matrix:
    """A dense matrix from one flat array as (k, v), k being the place in the array."""
    if check:
        n = df.count()
        if (nrow == 0 and n != 0) or (nrow and (n % nrow or n // nrow != ncol)):
            raise ValueError("there should be as many values as the product of the extents")
    width = max(1, ncol if row_major else nrow)
    p, s = F.expr(f"k div {width}L"), F.expr(f"k % {width}L")
    r, c = (p, s) if row_major else (s, p)
    return Matrix(df.select(r.alias("r"), c.alias("c"), _typed(F.col("v"), dtype).alias("v")), nrow, ncol, sparse=False, full=True, p_sparse=0.0, p_rows=1.0 if row_major else 0.0, dtype=dtype)


def from_fragmented(df: DataFrame, nrow: int, ncol: int, *, row: bool = True, check: bool = True, dtype: str = "double") -> Matrix:
    """A sparse matrix from (i, index, value): two arrays for each row or column; elements without entries may be absent."""
    if check:
        _check_fragments(df, *((nrow, ncol) if row else (ncol, nrow)))
    long = df.select(F.col("i").cast("long").alias("p"), F.explode(F.arrays_zip("index", "value")).alias("e"))
    r, c = ("p", "s") if row else ("s", "p")
    long = long.select("p", F.col("e.index").cast("long").alias("s"), _typed(F.col("e.value"), dtype).alias("v"))
    return Matrix(long.select(F.col(r).alias("r"), F.col(c).alias("c"), "v"), nrow, ncol, p_rows=1.0 if row else 0.0, dtype=dtype)


def _check_fragments(df: DataFrame, most: int, width: int) -> None:
    """One job looks at each element once; only if something is wrong do others look for the first offending one."""
    # neighbours are paired as arrays: element_at() of a column that is worked out would work it out for every index
    falls = F.exists(F.zip_with("index", F.slice("index", 2, F.size("index")), lambda a, b: a >= b), lambda x: x)
    wrong = {
        "an element should lie within the primary extent": F.col("i").isNull() | ~F.col("i").between(0, most - 1),
        "an element of the primary extent should come once": None,
        "an element should have the same number of indices and values": F.size("index") != F.size("value"),
        "an index should not be negative and be less than the extent": F.exists("index", lambda x: x.isNull() | (x < 0) | (x >= width)),
        "the indices of an element should be strictly increasing": falls,
    }
    flags = df.select("i", *[F.lit(False).alias(f"x{k}") if x is None else x.alias(f"x{k}") for k, x in enumerate(wrong.values())])
    once = flags.groupBy("i").agg(F.count("*").alias("count"), *[F.bool_or(f"x{k}").alias(f"x{k}") for k in range(len(wrong))])
    found = once.agg(F.bool_or((F.col("count") > 1) | F.greatest(*[F.coalesce(f"x{k}", F.lit(False)) for k in range(len(wrong))]))).first()[0]
    for message, x in wrong.items() if found else ():
        _fail_if(df.groupBy("i").count().where("count > 1") if x is None else df.where(x), message)


#: Places of the flat arrays that are sorted together.
SPAN = 65_536


def from_compressed_tables(contents: DataFrame, pointers: DataFrame, nrow: int, ncol: int, *, csr: bool = True, check: bool = True, dtype: str = "double") -> Matrix:
    """A sparse matrix from flat arrays as tables: (k, index, v), k being the place in the arrays, and (i, pointer) with one more row than the primary extent.

    Each element's range of places is cut at multiples of SPAN; within such a span the last range that begins at or before a
    place owns it, so places find their element by one shuffle on the span, whatever the elements' sizes.
    """
    most, width = (nrow, ncol) if csr else (ncol, nrow)
    contents = contents.select(F.col("k").cast("long").alias("k"), F.col("index").cast("long").alias("s"), _typed(F.col("v"), dtype).alias("v"))
    pointers = pointers.select(F.col("i").cast("long").alias("i"), F.col("pointer").cast("long").alias("a"))
    ends = pointers.select((F.col("i") - 1).alias("i"), F.col("a").alias("b"))
    ranges = pointers.where(F.col("i") < most).join(ends, "i")
    if check:
        _check_pointers(contents, pointers, ranges, most)
    spans = F.sequence(F.expr(f"a div {SPAN}L"), F.expr(f"(b - 1) div {SPAN}L"))
    heads = ranges.where("a < b").select("i", "a", F.explode(spans).alias("span")).select("span", F.greatest("a", F.col("span") * SPAN).alias("k"), F.lit(0).alias("kind"), F.col("i").alias("p"), F.lit(None).cast("long").alias("s"), F.lit(None).cast(dtype).alias("v"))
    own = contents.select(F.expr(f"k div {SPAN}L").alias("span"), "k", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("p"), "s", "v")
    order = Window.partitionBy("span").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = heads.union(own).withColumn("p", F.last("p", ignorenulls=True).over(order)).where("kind = 1")
    if check:
        _fail_if(met.where(f"s is null or s < 0 or s >= {width}").select("p", "k", "s"), "an index should not be negative and be less than the secondary extent")
        before = F.lag("s").over(Window.partitionBy("p", F.expr(f"k div {SPAN}L")).orderBy("k"))
        edge = met.where(f"k % {SPAN}L in (0, {SPAN - 1}L)").select("p", "k", "s")
        falls = met.select("p", "k", "s", before.alias("earlier")).where("s <= earlier")
        seams = edge.alias("x").join(edge.alias("y"), (F.col("x.p") == F.col("y.p")) & (F.col("y.k") == F.col("x.k") + 1)).where("y.s <= x.s").select("y.p", "y.k", "y.s", F.col("x.s").alias("earlier"))
        _fail_if(falls.union(seams), "the indices of an element should be strictly increasing")
    r, c = ("p", "s") if csr else ("s", "p")
    return Matrix(met.select(F.col(r).alias("r"), F.col(c).alias("c"), "v"), nrow, ncol, p_rows=1.0 if csr else 0.0, dtype=dtype)


def _check_pointers(contents: DataFrame, pointers: DataFrame, ranges: DataFrame, most: int) -> None:
    rows, positions, least, last = pointers.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    if (rows, positions, least, last) != (most + 1, most + 1, 0, most):
        raise ValueError(f"there should be one pointer for each of 0 to {most}, which is equal to the primary extent; found {rows} rows for {positions} of {least} to {last}")
    n, places, low, high = contents.agg(F.count("*"), F.countDistinct("k"), F.min("k"), F.max("k")).first()
    if n and (places, low, high) != (n, 0, n - 1):
        raise ValueError(f"the places of the contents should be 0 to {n - 1}, once each; found {places} from {low} to {high}")
    _fail_if(pointers.where("i = 0 and not a <=> 0"), "the first pointer should be zero")
    _fail_if(pointers.where(f"i = {most} and not a <=> {n}L"), f"the last element of the pointers should be the number of indices, {n}")
    _fail_if(ranges.where("b < a"), "pointers should not decrease")


def from_compressed(spark: SparkSession, values: Sequence[float], indices: Sequence[int], pointers: Sequence[int], nrow: int, ncol: int, *, csr: bool = True, check: bool = True, dtype: str = "double") -> Matrix:
    """A sparse matrix from three flat sequences on the driver; they become the tables of from_compressed_tables()."""
    if len(values) != len(indices):
        raise ValueError(f"there are {len(values)} values and {len(indices)} indices; they should be of the same length")
    contents = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values)), "index": np.asarray(indices, np.int64), "v": np.asarray(values, float)}), "k long, index long, v double")
    where = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(pointers)), "pointer": np.asarray(pointers, np.int64)}), "i long, pointer long")
    return from_compressed_tables(contents, where, nrow, ncol, csr=csr, check=check, dtype=dtype)


def constant(spark: SparkSession, nrow: int, ncol: int, value: float) -> Matrix:
    """Every cell the same; nothing is stored. Sparse for zero only; rows are preferred."""
    zero = value == 0
    none = spark.range(0).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(0.0).alias("v"))
    return Matrix(none, nrow, ncol, sparse=zero, fill=None if zero else F.lit(float(value)), p_sparse=float(zero))


def sorted_triplets(df: DataFrame, num_primary: int) -> tuple[DataFrame, DataFrame]:
    """Triplets (primary, secondary, v) as flat arrays: (k, primary, index, v), k being the place, and pointers (i, pointer).

    Entries are by primary and secondary position, then value; repeated positions stay. They are sorted over ranges of all three, and each
    range begins where the counts of those before it end, so no element, however long, is gathered in one task. Equal triplets
    are sorted as one with a count.
    """
    spark = df.sparkSession
    order = ["primary", "secondary", "v"]
    kinds = df.groupBy(*order).agg(F.count("*").alias("n"))
    shared_folder(spark)
    # kept, so that counting and numbering see the same ranges
    ranged = kinds.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    heads = ranged.groupBy("range").agg(F.sum("n").alias("size")).select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("head"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("head") + F.coalesce(F.col("earlier"), F.lit(0))
    placed = ranged.withColumn("earlier", F.sum("n").over(within)).join(F.broadcast(heads), "range")
    flat = placed.select(F.explode(F.sequence(first, first + F.col("n") - 1)).alias("k"), "primary", F.col("secondary").alias("index"), "v")
    return flat, _pointers(spark, ranged.select("primary", "n"), num_primary)


def _pointers(spark: SparkSession, sizes: DataFrame, num_primary: int) -> DataFrame:
    counts = sizes.groupBy((F.col("primary") + 1).alias("i")).agg(F.sum("n").alias("n"))
    every = spark.range(num_primary + 1).select(F.col("id").alias("i")).join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return running_total(every, "n").select("i", F.col("total").alias("pointer"))


def compress_triplets(df: DataFrame, num_primary: int) -> tuple[DataFrame, DataFrame]:
    """Triplets (primary, secondary, v) as (i, index, value) for each primary element, and pointers (i, pointer).

    Entries are by secondary position, then value; repeated positions stay. `pointers` has num_primary + 1 rows. An element's arrays
    are one row here; sorted_triplets() gives elements of any length.
    """
    spark = df.sparkSession
    grouped = df.groupBy(F.col("primary").alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col("secondary").alias("s"), F.col("v").alias("v")))).alias("e"))
    every = spark.range(num_primary).withColumnRenamed("id", "i").join(grouped, "i", "left")
    arrays = every.select("i", F.coalesce("e.s", F.array().cast("array<bigint>")).alias("index"), F.coalesce("e.v", F.array().cast("array<double>")).alias("value"))
    return arrays, _pointers(spark, df.groupBy("primary").agg(F.count("*").alias("n")), num_primary)


def from_triplets(df: DataFrame, nrow: int, ncol: int, *, csr: bool = True, combine: str | None = None, check: bool = True) -> Matrix:
    """A sparse matrix from (primary, secondary, v) in any order; repeated positions are an error unless combined."""
    r, c = ("primary", "secondary") if csr else ("secondary", "primary")
    return from_coo(df.select(F.col(r).alias("r"), F.col(c).alias("c"), "v"), nrow, ncol, check=check, combine=combine, csr=csr)


def from_custom(make: Callable[[SparkSession], DataFrame], spark: SparkSession, nrow: int, ncol: int, **options) -> Matrix:
    """A matrix from a function that returns (r, c, v) rows."""
    return from_coo(make(spark), nrow, ncol, **options)
