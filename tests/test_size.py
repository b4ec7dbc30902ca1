"""Work that has to grow with the entries, not with their square or with the number of tiles."""

import math
import time
from pathlib import Path

import numpy as np
import pytest
from gridloom import sinks, sources, unary
from gridloom.plans.selection import Selection
from gridloom.sources import store
from gridloom.sources.packed import _kinds, narrowest
from pyspark.sql import functions as F
from test_layout import array, coo, files_read, simulate


def test_long_fragments_are_checked_in_linear_time(spark):
    """The arrays are worked out by a plan, as sinks.fragmented_contents() makes them."""
    n = 60_000
    m = sources.from_coo(spark.range(2 * n).select((F.col("id") % n).alias("r"), F.expr(f"id div {n}").alias("c"), F.lit(1.0).alias("v")), n, 2)
    began = time.monotonic()
    got = sources.from_fragmented(sinks.fragmented_contents(m, False), n, 2, row=False)
    assert got.entries.count() == 2 * n
    assert time.monotonic() - began < 60


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([(0, [1], [1.0]), (2, [1], [1.0])], "primary extent"),
        ([(None, [1], [1.0])], "primary extent"),
        ([(0, [1], [1.0]), (0, [2], [1.0])], "come once"),
        ([(0, [1, 2], [1.0])], "same number"),
        ([(0, [1, 9], [1.0, 2.0])], "less than the extent"),
        ([(0, [1, None], [1.0, 2.0])], "less than the extent"),
        ([(0, [], []), (1, [0, 2, 2], [1.0, 2.0, 3.0])], "strictly increasing"),
        ([(1, [2, 1], [1.0, 2.0])], "strictly increasing"),
    ],
)
def test_wrong_fragments(spark, rows, message):
    df = spark.createDataFrame(rows, "i long, index array<long>, value array<double>")
    with pytest.raises(ValueError, match=message):
        sources.from_fragmented(df, 2, 9)


@pytest.mark.parametrize("fill", [False, True])
def test_many_tiles_share_files(spark, tmp_path, fill):
    a = simulate(8, 90, 70, 0.3)
    m, want = (unary.arithmetic(coo(spark, a), "add", np.arange(90.0), by_row=True), a + np.arange(90.0)[:, None]) if fill else (coo(spark, a), a)
    path = f"{tmp_path}/tiles"
    sources.write_tiles(m, path, (2, 1))
    assert len(list(Path(path, "tiles").rglob("*.parquet"))) <= store.FOLDERS + 4  # of 3,150 tiles
    got = sources.open_tiles(spark, path)
    np.testing.assert_allclose(array(got).astype(float), want)
    assert files_read(got.narrowed(Selection(0, 90), Selection(0, 70))) == files_read(got.entries) > files_read(got.narrowed(Selection(5, 3), Selection(7, 3)))
    some = got.dense_row(20, 10, at=[3, 50, 51]).collect()
    np.testing.assert_allclose([list(r.x) for r in sorted(some, key=lambda r: r.i)], want[[3, 50, 51], 20:30])
    far = got.dense_row(at=range(0, 90, 1)).collect()
    np.testing.assert_allclose([list(r.x) for r in sorted(far, key=lambda r: r.i)], want)
    own = sorted(map(tuple, m.entries.where("v between 1 and 2").collect()))
    assert sorted(map(tuple, sources.entries_between(spark, path, 1.0, 2.0).collect())) == own
    stats = sources.tile_stats(spark, path).collect()
    assert {(r.tr, r.tc): r.n for r in stats} == {(i // 2, j): int(np.count_nonzero(a[i : i + 2, j])) for i in range(0, 90, 2) for j in range(70) if a[i : i + 2, j].any()}


def test_statistics_are_written_by_several_tasks(spark, tmp_path):
    m = sources.from_coo(spark.range(4000).select((F.col("id") % 80).alias("r"), F.expr("id div 80").alias("c"), F.lit(1.0).alias("v")), 80, 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sources.write_tiles(m, f"{tmp_path}/tiles", (1, 1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(tmp_path, "tiles/stats").glob("*.parquet"))) > 1
    assert sources.count_stored(spark, f"{tmp_path}/tiles") == 4000


def single(spark, n=60_000):
    """Tiles of 2 by 2 with an entry each."""
    return sources.from_coo(spark.range(n).select((F.col("id") * 2).alias("r"), (F.col("id") * 2).alias("c"), (F.col("id") % 300).cast("double").alias("v")), 2 * n, 2 * n)


def test_many_small_tiles_are_packed_together(spark, tmp_path):
    sources.write_packed(coo(spark, np.ones((4, 4))), f"{tmp_path}/first", (2, 2))
    began = time.monotonic()
    sources.write_packed(single(spark), f"{tmp_path}/packed", (2, 2))
    assert time.monotonic() - began < 40
    kinds = {r.value_kind: r["count"] for r in sources.packed_tiles(spark, f"{tmp_path}/packed").groupBy("value_kind").count().collect()}
    assert kinds == {"int8": 200 * 128, "int16": 200 * 172}
    began = time.monotonic()
    got = sources.open_packed(spark, f"{tmp_path}/packed").entries
    assert got.where("r = c and v = (r div 2) % 300").count() == 60_000
    assert time.monotonic() - began < 40


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("dtype", ["double", "float", "bigint", "tinyint"])
def test_packed_tiles_across_batches(spark, tmp_path, batch, dtype):
    a = np.round(simulate(9, 40, 30, 0.5) * 10) if dtype in ("bigint", "tinyint") else simulate(9, 40, 30, 0.5)
    if dtype == "float":
        a = a.astype(np.float32)
    whole = a.astype(np.int64) if dtype in ("bigint", "tinyint") else a
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        sources.write_packed(coo(spark, whole, dtype), f"{tmp_path}/packed", (8, 16))
        np.testing.assert_array_equal(array(sources.open_packed(spark, f"{tmp_path}/packed")).astype(a.dtype), whole)
        tiles = sources.packed_tiles(spark, f"{tmp_path}/packed").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({(t.tr, t.tc) for t in tiles}) == len(tiles) == 10
    for t in tiles:
        part = whole[t.tr * 8 : t.tr * 8 + 8, t.tc * 16 : t.tc * 16 + 16]
        assert (t.n, t.value_kind) == (np.count_nonzero(part), narrowest(part[part != 0]))


def test_kinds_of_stretches():
    parts = [[0.0, 127.0], [-0.0, 1.0], [math.nan, 1.0], [0.5], [0.1], [2.0**61], [2.0**62], [2.0**31], [-(2.0**31)], [40_000.0, -1.0]]
    for kind in (float, np.float32):
        v = np.concatenate(parts).astype(kind)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        ends = np.append(starts[1:], len(v))
        assert _kinds(v, starts, ends) == [narrowest(v[a:b]) for a, b in zip(starts, ends, strict=True)]
