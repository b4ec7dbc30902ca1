"""A stored matrix: tiles of entries as partitioned Parquet, a table of their statistics, and what the plan has to know.

A folder has `tiles` (partitioned by tile row and tile column, or by square groups of tiles where there may be more than
FOLDERS tiles), `stats` (one row a tile: its entries, least and greatest value) and `shape` (extents, type, preferences,
fill), and, where the fill differs by row or by column, `fills`. Reads name the tiles, or groups, that they need, so no
other file is opened; within a file, entries are sorted by tile, so row groups of others are left out by their statistics.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix, Vector
from ..plans.extract import by_line, fill_of
from ..plans.selection import Selection
from ..plans.sinks import fill_compressed, pointers_of, stretch_counts

#: Rows and columns of a tile, if not told otherwise: some 16 million cells at most.
TILE = (4096, 4096)
#: Folders that the tiles are dealt to at most.
FOLDERS = 256


def write_tiles(m: Matrix, path: str, tile: tuple[int, int] = TILE, mode: str = "errorifexists") -> None:
    """Stores a matrix in a folder. One pass writes the tiles, over ranges of them and each by one task (a tile has at most as many entries as
    cells), another one reads what Parquet's own statistics can't give by tile. A fill that depends on rows and columns at once is stored as entries."""
    if m.fill is not None and not (by_line(m, True) or by_line(m, False)):
        m = m.with_(entries=m.cells(), full=True, fill=None, vectors=())
    high, wide = tile
    spark = m.entries.sparkSession
    group = _group(-(-m.nrow // high), -(-m.ncol // wide))
    placed = m.entries.select("r", "c", "v", F.expr(f"r div {high}L").alias("tr"), F.expr(f"c div {wide}L").alias("tc"))
    folder = ["tr", "tc"]
    if group > 1:
        folder = ["gr", "gc"]
        placed = placed.select("*", F.expr(f"tr div {group}L").alias("gr"), F.expr(f"tc div {group}L").alias("gc"))
    by_tile = list(dict.fromkeys([*folder, "tr", "tc"]))
    placed.repartitionByRange(*by_tile).sortWithinPartitions(*by_tile, "r", "c").write.mode(mode).partitionBy(*folder).parquet(f"{path}/tiles")
    written = _tiles(spark, path, m.dtype, group)
    v = F.col("v").cast("double")
    stats = written.groupBy("tr", "tc").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(v == 0).alias("zeros"))
    stats.write.mode(mode).parquet(f"{path}/stats")
    fill = None
    if m.fill is not None and not m.full:
        if m.vectors:
            by_row = m.vectors[0].by_row
            lines = spark.range(m.nrow if by_row else m.ncol).select(F.col("id").alias("r" if by_row else "c"))
            for vector in m.vectors:
                lines = vector.join(lines)
            lines.select(F.col("r" if by_row else "c").alias("i"), fill_of(m).alias("w")).write.mode(mode).parquet(f"{path}/fills")
            fill = "rows" if by_row else "columns"
        else:
            fill = spark.range(1).select(fill_of(m).cast("string")).first()[0]
    told = {"nrow": m.nrow, "ncol": m.ncol, "dtype": m.dtype, "sparse": m.sparse, "full": m.full, "p_sparse": m.p_sparse, "p_rows": m.p_rows, "tile": [high, wide], "group": group, "vectors": bool(m.vectors) and fill is not None, "fill": fill}
    spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode(mode).text(f"{path}/shape")


def open_tiles(spark: SparkSession, path: str) -> Matrix:
    """A stored matrix. Selected rows and columns become partition filters on the tiles that hold them, and ranges within."""
    told = json.loads(spark.read.text(f"{path}/shape").first()[0])
    nrow, ncol, (high, wide) = told["nrow"], told["ncol"], told["tile"]
    group = told.get("group", 1)
    tiles = _tiles(spark, path, told["dtype"], group)

    def reader(rows: Selection, columns: Selection) -> DataFrame:
        some = tiles
        for name, each in (("g", group), ("t", 1))[group == 1 :]:
            some = rows.grouped(high * each).keep(some, f"{name}r", -(-nrow // (high * each)))
            some = columns.grouped(wide * each).keep(some, f"{name}c", -(-ncol // (wide * each)))
        return columns.keep(rows.keep(some, "r", nrow), "c", ncol).select("r", "c", "v")

    fill: Column | None = None
    vectors: tuple[Vector, ...] = ()
    if told["vectors"]:
        by_row = told["fill"] == "rows"
        name = "_stored_fill"
        vectors = (Vector(name, spark.read.parquet(f"{path}/fills").withColumnRenamed("w", name), by_row, False),)
        fill = F.col(name)
    elif told["fill"] is not None:
        fill = F.lit(told["fill"]).cast(told["dtype"])
    return Matrix(tiles.select("r", "c", "v"), nrow, ncol, sparse=told["sparse"], full=told["full"], fill=fill, vectors=vectors, p_sparse=told["p_sparse"], p_rows=told["p_rows"], dtype=told["dtype"], reader=reader)


def _group(high: int, wide: int) -> int:
    """Tile rows and tile columns of a folder: the least number that makes FOLDERS folders at most."""
    group = max(1, math.isqrt(high * wide // FOLDERS))
    while -(-high // group) * -(-wide // group) > FOLDERS:
        group += 1
    return group


def _tiles(spark: SparkSession, path: str, dtype: str, group: int) -> DataFrame:
    return spark.read.schema(f"r long, c long, v {dtype}, tr long, tc long{', gr long, gc long' * (group > 1)}").parquet(f"{path}/tiles")


def tile_stats(spark: SparkSession, path: str) -> DataFrame:
    """(tr, tc, n, least, most, nans, zeros) of each tile with entries."""
    return spark.read.parquet(f"{path}/stats")


def entries_between(spark: SparkSession, path: str, least: float, most: float) -> DataFrame:
    """(r, c, v): the stored entries with least <= v <= most. Tiles whose statistics rule them out are not read; NaN is in no range.

    Tiles are chosen by a join with the statistics, which Spark turns into a filter on partitions when it runs.
    """
    told = json.loads(spark.read.text(f"{path}/shape").first()[0])
    # NaN counts as the greatest value there
    near = tile_stats(spark, path).where((F.col("least") <= least) & (F.col("most") >= least) | F.col("least").between(least, most)).select("tr", "tc")
    group, keys = told.get("group", 1), ["tr", "tc"]
    tiles = _tiles(spark, path, told["dtype"], group)
    if group > 1:  # folders are chosen, and then tiles
        keys = ["gr", "gc", "tr", "tc"]
        near = near.select(F.expr(f"tr div {group}L").alias("gr"), F.expr(f"tc div {group}L").alias("gc"), "tr", "tc")
    found = tiles.join(F.broadcast(near), keys) if near.count() <= 1_000_000 else tiles.join(near, keys)
    return found.where(F.col("v").between(least, most) & ~F.isnan(F.col("v").cast("double"))).select("r", "c", "v")


def count_stored(spark: SparkSession, path: str) -> int:
    """The number of stored entries, from the statistics alone."""
    return tile_stats(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Places of the flat arrays that one row of a stored compressed matrix holds.
CHUNK = 65_536


def write_compressed(m: Matrix, path: str, row: bool = True, mode: str = "errorifexists") -> None:
    """Stores a sparse matrix's flat arrays in two passes: entries are counted by row (or column) and stretch, which fixes the pointers, then written at their places.

    A folder has `counts` (p, b, n), the first pass's, `pointers` (i, pointer) and `chunks`: each CHUNK places of the arrays as one row, with the
    runs of its rows (or columns). The matrix is worked out once a pass; no pass holds more than a chunk, however long a row is. A matrix whose
    absent cells aren't zero is stored by its cells that aren't.
    """
    spark = m.entries.sparkSession
    extent = m.nrow if row else m.ncol
    stretch_counts(m, row).write.mode(mode).parquet(f"{path}/counts")
    sizes = spark.read.schema("p long, b long, n long").parquet(f"{path}/counts")
    start = spark.range(1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("pointer"))
    pointers_of(sizes, extent).select((F.col("i") + 1).alias("i"), F.col("total").alias("pointer")).unionByName(start).write.mode(mode).parquet(f"{path}/pointers")
    flat = fill_compressed(m, row, sizes).select("k", "p", "s", "v", F.expr(f"k div {CHUNK}L").alias("chunk"))
    # ranges of chunks are what the aggregation needs, so entries move once for both
    sorted_ = flat.repartitionByRange("chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("k", "p", "s", "v"))).alias("e"))
    first, size = F.element_at("e", 1), F.size("e")
    heads = F.filter(F.sequence(F.lit(1), size), lambda j: (j == 1) | (F.element_at("e", j)["p"] != F.element_at("e", F.greatest(j - 1, F.lit(1)))["p"]))
    shown = sorted_.select("chunk", first["p"].alias("least"), F.element_at("e", -1)["p"].alias("most"), heads.alias("heads"), "e")
    ends = F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array(size + 1))
    runs = F.zip_with("heads", ends, lambda a, b: F.struct(F.element_at("e", a)["p"].alias("p"), (b - a).alias("n")))
    shown = shown.select("chunk", "least", "most", runs.alias("runs"), F.col("e.s").alias("index"), F.col("e.v").alias("value"))
    shown.sortWithinPartitions("chunk").write.mode(mode).parquet(f"{path}/chunks")
    told = {"nrow": m.nrow, "ncol": m.ncol, "dtype": m.dtype, "row": row, "extent": extent}
    spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode(mode).text(f"{path}/shape")


def open_compressed(spark: SparkSession, path: str) -> Matrix:
    """A matrix stored by write_compressed(). Chunks are taken apart by their runs, without a sort, a window or a shuffle; selected rows (or columns) become ranges on the chunks' first and last ones."""
    told = json.loads(spark.read.text(f"{path}/shape").first()[0])
    nrow, ncol, row, dtype = told["nrow"], told["ncol"], told["row"], told["dtype"]
    chunks = spark.read.schema(f"chunk long, least long, most long, runs array<struct<p:long,n:int>>, index array<long>, value array<{dtype}>").parquet(f"{path}/chunks")

    def apart(some: DataFrame) -> DataFrame:
        lines = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["p"], r["n"])))
        long = some.select(F.inline(F.arrays_zip(lines.alias("p"), F.col("index").alias("s"), F.col("value").alias("v"))))
        r, c = ("p", "s") if row else ("s", "p")
        return long.select(F.col(r).alias("r"), F.col(c).alias("c"), "v")

    def reader(rows: Selection, columns: Selection) -> DataFrame:
        main = rows if row else columns
        some = chunks
        if main.length and (runs := main.runs()):
            some = some.where((F.col("most") >= runs[0][0]) & (F.col("least") < runs[-1][0] + runs[-1][1]))
        return columns.keep(rows.keep(apart(some), "r", nrow), "c", ncol)

    return Matrix(apart(chunks), nrow, ncol, p_rows=1.0 if row else 0.0, dtype=dtype, reader=reader)


def stored_contents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The flat arrays (k, index, v) and the pointers (i, pointer) of a stored compressed matrix, as from_compressed_tables() takes them."""
    chunks = spark.read.parquet(f"{path}/chunks")
    flat = chunks.select("chunk", F.posexplode(F.arrays_zip(F.col("index").alias("index"), F.col("value").alias("v"))).alias("at", "e"))
    return flat.select((F.col("chunk") * CHUNK + F.col("at")).alias("k"), "e.index", "e.v"), spark.read.parquet(f"{path}/pointers")
