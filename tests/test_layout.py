import math
import os

import numpy as np
import pytest
from gridloom import binary, blocks, reshape, sinks, sources, unary
from gridloom.functions import whole
from gridloom.functions.arrays import of_cells, of_pairs
from gridloom.plans import extract as extract_module
from gridloom.plans.extract import ConsecutiveOracle, FixedOracle, deliver
from gridloom.plans.selection import RANGES, Selection
from gridloom.sources import store
from gridloom.sources.packed import narrowest
from pyspark.sql import functions as F


def simulate(seed, nrow, ncol, density):
    rng = np.random.default_rng(seed)
    return np.round(np.where(rng.random((nrow, ncol)) < density, rng.uniform(-5, 5, (nrow, ncol)), 0.0), 2)


def coo(spark, a, dtype="double"):
    rows = [(int(r), int(c), a[r, c].item()) for r, c in zip(*np.nonzero(a), strict=True)]
    return sources.from_coo(spark.createDataFrame(rows, f"r long, c long, v {dtype}"), *a.shape, dtype=dtype)


def array(m):
    out = np.full((m.nrow, m.ncol), -999, object)
    for r in m.cells().collect():
        out[r.r, r.c] = r.v
    return out


def lines(df):
    return {r.i: list(r.x) for r in df.collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    query = df._jdf.queryExecution()
    query.toRdd().count()
    return query.executedPlan().collectLeaves().head().metrics().get("numFiles").get().value()


def test_selections_become_the_childs_own():
    s = Selection.of([1, 4, 5, 9, 30], 40)
    assert s.within(4, 10) == Selection.of([0, 1, 5], 10) and s.within(10, 5).length == 0
    assert s.grouped(5) == Selection.of([0, 1, 6], 8) and Selection(3, 9).grouped(5) == Selection(0, 3)
    assert s.runs() == [(1, 1), (4, 2), (9, 1), (30, 1)] and Selection(3, 9).within(5, 100) == Selection(0, 7)
    assert Selection.of([3, 4, 5], 9) == Selection(3, 3) and Selection(0, 0).grouped(7).length == 0


def test_many_listed_positions_reach_the_scan_as_ranges(spark, tmp_path):
    a = simulate(1, 4000, 6, 0.4)
    coo(spark, a).entries.write.parquet(f"{tmp_path}/m")
    m = sources.from_coo(spark.read.parquet(f"{tmp_path}/m"), *a.shape)
    few = [*range(40, 60), *range(1000, 1400), 3999]
    many = list(range(700, 3900, 3))
    for listed in (few, many):
        df = m.dense_row(at=listed)
        plan = plan_of(df)
        assert "GreaterThanOrEqual(r," in plan and "LessThan" in plan
        assert lines(df) == {i: a[i].tolist() for i in listed}
    assert len(Selection.of(many, 4000).runs()) > RANGES
    assert lines(m.dense_column([*range(5, 900), *many[200:]])) == {j: a[[*range(5, 900), *many[200:]], j].tolist() for j in range(6)}


def test_bound_matrices_are_asked_by_their_own_positions(spark, tmp_path):
    parts = [simulate(k, n, 8, 0.5) for k, n in enumerate((30, 50, 20))]
    whole_ = np.vstack(parts)
    stored = []
    for k, a in enumerate(parts):
        coo(spark, a).entries.write.parquet(f"{tmp_path}/{k}")
        stored.append(sources.from_coo(spark.read.parquet(f"{tmp_path}/{k}"), *a.shape))
    stored[1] = unary.arithmetic(stored[1], "add", 1.0)
    whole_[30:80] += 1.0
    m = reshape.bind(stored, True)
    one = m.dense_row(at=(85, 10))
    plan = plan_of(one)
    assert plan.count("FileScan parquet") == 1 and "GreaterThanOrEqual(r,5)" in plan and "LessThan(r,15)" in plan
    assert lines(one) == {i: whole_[i].tolist() for i in range(85, 95)}
    listed = [0, 29, 30, 31, 50, 79, 80, 99]
    assert lines(m.dense_row(at=listed)) == {i: whole_[i].tolist() for i in listed}
    turned = reshape.subset_block(reshape.transpose(m), 20, 40, False)
    assert lines(turned.dense_column(at=(3, 5))) == {i: whole_[20 + i].tolist() for i in range(3, 8)}
    assert plan_of(turned.dense_column(at=(3, 5))).count("FileScan parquet") == 1
    picked = reshape.subset(m, [99, 3, 3, 40], True)
    assert lines(picked.dense_row(at=(1, 2))) == {1: whole_[3].tolist(), 2: whole_[3].tolist()}
    both = binary.arithmetic(m, unary.arithmetic(m, "multiply", 2.0), "add")
    assert plan_of(both.dense_row(at=(0, 4))).count("FileScan parquet") == 2
    np.testing.assert_allclose(np.array([lines(both.dense_row(at=(28, 4)))[i] for i in range(28, 32)]), 3 * whole_[28:32])
    assert reshape.bind(stored, True).dense_row(at=(0, 0)).count() == 0


@pytest.mark.parametrize("fill", ["none", "constant", "rows", "columns", "both"])
def test_stored_tiles(spark, tmp_path, fill):
    a = simulate(5, 90, 40, 0.2)
    m, want = coo(spark, a), a.copy()
    if fill == "constant":
        m, want = unary.arithmetic(m, "add", 2.5), a + 2.5
    if fill in ("rows", "both"):
        w = np.arange(90.0)
        m, want = unary.arithmetic(m, "add", w, by_row=True), want + w[:, None]
    if fill in ("columns", "both"):
        w = np.arange(40.0) * 0.5
        m, want = unary.arithmetic(m, "add", w, by_row=False), want + w[None, :]
    path = f"{tmp_path}/tiles"
    sources.write_tiles(m, path, (16, 8))
    got = sources.open_tiles(spark, path)
    assert (got.nrow, got.ncol, got.is_sparse(), got.prefer_rows()) == (90, 40, m.is_sparse() and fill != "both", True)
    np.testing.assert_allclose(array(got).astype(float), want)
    rows = got.narrowed(Selection(20, 10), Selection(0, 40))
    assert files_read(rows) == 5
    assert files_read(got.narrowed(Selection.of([3, 88], 90), Selection.of([0, 39], 40))) == 4
    assert files_read(got.entries) == 30
    np.testing.assert_allclose(np.array([lines(got.dense_row(5, 20, at=(20, 10)))[i] for i in range(20, 30)]), want[20:30, 5:25])
    stats = {(r.tr, r.tc): r for r in sources.tile_stats(spark, path).collect()}
    assert sources.count_stored(spark, path) == sum(r.n for r in stats.values()) == got.entries.count()
    own = m.cells() if fill == "both" else m.entries
    between = sorted(map(tuple, own.where("v between 1 and 2").collect()))
    assert sorted(map(tuple, sources.entries_between(spark, path, 1.0, 2.0).collect())) == between
    with pytest.raises(Exception, match="(?i)exist"):
        sources.write_tiles(m, path)


def test_stored_tiles_of_nothing_and_of_odd_values(spark, tmp_path):
    empty = sources.from_coo(spark.createDataFrame([], "r long, c long, v double"), 7, 3)
    sources.write_tiles(empty, f"{tmp_path}/a")
    assert array(sources.open_tiles(spark, f"{tmp_path}/a")).astype(float).sum() == 0
    odd = sources.from_coo(spark.createDataFrame([(0, 0, math.nan), (1, 1, math.inf), (2, 2, -0.0), (3, 3, 1.5)], "r long, c long, v double"), 4, 4)
    sources.write_tiles(unary.arithmetic(odd, "divide", 0.0), f"{tmp_path}/c")
    assert all(math.isnan(v) or math.isinf(v) for v in array(sources.open_tiles(spark, f"{tmp_path}/c")).flatten())
    sources.write_tiles(odd, f"{tmp_path}/b", (2, 2))
    assert [tuple(r) for r in sources.entries_between(spark, f"{tmp_path}/b", 1.0, 2.0).collect()] == [(3, 3, 1.5)]
    long = sources.from_coo(spark.createDataFrame([(0, 0, 2**53 + 1)], "r long, c long, v long"), 1, 1, dtype="bigint")
    sources.write_tiles(long, f"{tmp_path}/d")
    assert array(sources.open_tiles(spark, f"{tmp_path}/d"))[0, 0] == 2**53 + 1


def gathered(df, shape, by_row):
    out = np.full(shape, np.nan)
    for r in df.collect():
        part = np.array(r.x).reshape(r.length, r.width)
        where = (slice(r.start, r.start + r.length), slice(r.first, r.first + r.width))
        out[where if by_row else where[::-1]] = part if by_row else part.T
    return out


def giver():
    def give(place, block):
        block = block.dense() if isinstance(block, blocks.Csr) else block
        return {"start": [place.start], "length": [place.length], "first": [place.first], "width": [place.width], "x": [block.ravel().astype(float).tolist()]}

    return give


give = giver()  # workers can't import this module
GIVEN = "start long, length long, first long, width long, x array<double>"


def test_blocks_cover_the_matrix(spark):
    a = simulate(6, 23, 31, 0.2)
    w, z = np.arange(23.0), np.arange(31.0)
    m = coo(spark, a)
    by_row, by_column = unary.arithmetic(m, "add", w, by_row=True), unary.arithmetic(m, "subtract", z, by_row=False)
    cases = [(m, a), (unary.arithmetic(m, "add", 1.5), a + 1.5), (by_row, a + w[:, None]), (by_column, a - z), (unary.arithmetic(by_row, "add", z, by_row=False), a + w[:, None] + z), (unary.arithmetic(m, "divide", 0.0), None)]
    with np.errstate(all="ignore"):
        cases[-1] = (cases[-1][0], a / 0.0)
    for k, (made, want) in enumerate(cases):
        rows = k % 2 == 0
        np.testing.assert_array_equal(gathered(blocks.map_blocks(made, give, GIVEN, by_row=rows, length=5, width=7), a.shape, rows), want)
    np.testing.assert_array_equal(gathered(blocks.map_blocks(m, give, GIVEN, by_row=False, length=4, sparse=True), a.shape, False), a)
    np.testing.assert_array_equal(gathered(blocks.map_blocks(m, give, GIVEN), a.shape, True), a)
    whole_ = coo(spark, (a * 100).astype(np.int64), "bigint")
    np.testing.assert_array_equal(gathered(blocks.map_blocks(whole_, give, GIVEN, length=9), a.shape, True), (a * 100).astype(np.int64))


def test_blocks_are_bounded_and_may_be_none(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 12)
    m = coo(spark, simulate(7, 9, 20, 0.5))
    for options in ({}, {"length": 5}, {"length": 100, "width": 100}, {"width": 3}):
        sizes = [r.length * r.width for r in blocks.map_blocks(m, give, GIVEN, **options).collect()]
        assert max(sizes) <= 12 and sum(sizes) == 180
    assert blocks.map_blocks(sources.constant(spark, 0, 5, 1.0), give, GIVEN).count() == 0
    with pytest.raises(ValueError, match="sparse"):
        blocks.map_blocks(unary.arithmetic(m, "add", 1.0), give, GIVEN, sparse=True)


def test_whole_numbers_are_exact(spark):
    big = 2**53 + 1
    values = [big, -big, 7, -7, 0, 2**62]
    m = sources.from_rows(spark.createDataFrame([(0, values)], "i long, x array<bigint>"), 1, 6, dtype="bigint")
    does = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "modulo": lambda a, b: a % b, "integer_divide": lambda a, b: a // b}
    for op, f in does.items():
        for by in (1, -1, 3, -3):
            if op != "multiply" or by in (1, -1):
                got = unary.arithmetic(m, op, by)
                assert got.dtype == "bigint" and array(got)[0].tolist() == [f(v, by) for v in values]
        if op in ("add", "subtract"):
            assert array(unary.arithmetic(m, op, 5, right=False))[0].tolist() == [f(5, v) for v in values]
        assert array(unary.arithmetic(m, op, [1] * 6, by_row=False))[0].tolist() == [f(v, 1) for v in values]
    assert array(unary.arithmetic(reshape.subset_block(m, 0, 4, False), "modulo", 5, right=False))[0].tolist() == [5 % v for v in values[:4]]
    assert unary.arithmetic(m, "add", 1.0).dtype == "double" and unary.arithmetic(m, "divide", 2).dtype == "double"


def test_whole_types_meet_and_overflow_is_an_error(spark):
    assert whole.promoted("tinyint", "smallint") == "int" and whole.promoted("int", "bigint") == "bigint" and whole.promoted("int", None) is None
    assert whole.literal_type(True) is None and whole.literal_type(2**31) == "bigint" and whole.literal_type(2**63) is None
    a = simulate(8, 5, 6, 0.5).astype(int)
    small, long = coo(spark, a, "smallint"), coo(spark, a * 2**40, "bigint")
    got = binary.arithmetic(small, long, "subtract")
    assert got.dtype == "bigint" and got.is_sparse() and (array(got).astype(object) == a.astype(object) - a.astype(object) * 2**40).all()
    for m, op, by in ((coo(spark, np.array([[2**62]]), "bigint"), "multiply", 2), (coo(spark, np.array([[-(2**63)]], object).astype(np.int64), "bigint"), "integer_divide", -1), (small, "modulo", 0), (coo(spark, np.array([[2**31 - 1]]), "int"), "add", 1)):
        with pytest.raises(Exception, match="beyond its type|by zero"):
            unary.arithmetic(m, op, by).cells().collect()
    assert not unary.arithmetic(small, "add", 3).is_sparse() and unary.arithmetic(small, "multiply", 3).is_sparse()
    assert (array(unary.arithmetic(small, "add", 3)) == a + 3).all()


def test_acosh_keeps_digits_near_one(spark):
    x = [1.0, 1 + 1e-12, 1 + 1e-10, 1 + 1e-6, 1.5, 2.0, 1e9, 1e300, math.inf, 0.5, math.nan]
    m = sources.from_rows(spark.createDataFrame([(0, x)], "i long, x array<double>"), 1, len(x))
    got = array(unary.math_function(m, "acosh"))[0].astype(float)
    np.testing.assert_allclose(got, [math.acosh(v) if v >= 1 else math.nan for v in x], rtol=4e-15)


def test_the_fill_is_worked_out_once(spark):
    m = unary.arithmetic(coo(spark, simulate(9, 20, 30, 0.3)), "add", 1.0)
    plan = m.cells().where("v > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_repeat") <= 3
    assert sinks.sums(m).count() == 20 and m.cells().agg(F.count("*")).first()[0] == 600


def test_functions_of_arrays(spark):
    a, b = simulate(10, 12, 9, 0.4), simulate(11, 12, 9, 0.4)
    r, c = np.mgrid[:12, :9]
    m = coo(spark, a)

    def cell(v):
        return np.where(v > 2, np.nan, v * 3)

    def placed(v, r, c):
        return v * (r + 1) + c

    def by_row(v, r):
        return v + r

    def pair(x, y, c):
        return x * y + c

    kept = unary.custom(m, unary.Helper(of_cells(cell), keeps_zero=True))
    np.testing.assert_array_equal(array(kept).astype(float), cell(a))
    assert kept.is_sparse() and kept.entries.count() == np.count_nonzero(a)
    got = unary.custom(m, unary.Helper(of_cells(placed, row=True, column=True), depends_on_column=True))
    assert len(got.vectors) == 1 and got.entries.count() == np.count_nonzero(a)
    np.testing.assert_allclose(array(got).astype(float), placed(a, r, c))
    twice = unary.custom(unary.arithmetic(m, "add", np.arange(12.0), by_row=True), unary.Helper(of_cells(by_row, row=True), depends_on_row=True))
    np.testing.assert_allclose(array(twice).astype(float), a + 2 * r)
    mixed = unary.custom(unary.arithmetic(m, "add", np.arange(9.0), by_row=False), unary.Helper(of_cells(by_row, row=True), depends_on_row=True))
    assert mixed.full
    np.testing.assert_allclose(array(mixed).astype(float), a + c + r)
    two = binary.combine(m, coo(spark, b), binary.BinaryHelper(of_pairs(pair, column=True)))
    np.testing.assert_allclose(array(two).astype(float), a * b + c)
    few = lines(got.dense_row(2, 4, at=(3, 2)))
    np.testing.assert_allclose(np.array([few[3], few[4]]), placed(a, r, c)[3:5, 2:6])


@pytest.mark.parametrize("row", [True, False])
def test_compressed_storage(spark, tmp_path, monkeypatch, row):
    monkeypatch.setattr(store, "CHUNK", 16)
    a = simulate(12, 30, 25, 0.3)
    a[7], a[9:14] = np.arange(1, 26), 0
    m = coo(spark, a)
    path = f"{tmp_path}/c"
    sources.write_compressed(m, path, row)
    got = sources.open_compressed(spark, path)
    np.testing.assert_array_equal(array(got).astype(float), a)
    plan = plan_of(got.entries)
    assert not any(x in plan for x in ("Exchange", "Window", "Sort"))
    part = got.narrowed(Selection(6, 3), Selection(0, 25)) if row else got.narrowed(Selection(0, 30), Selection(6, 3))
    assert "GreaterThanOrEqual(most,6)" in plan_of(part)
    want = a[6:9] if row else a[:, 6:9]
    assert part.count() == np.count_nonzero(want) and part.agg(F.sum("v")).first()[0] == pytest.approx(want.sum())
    contents, pointers = sources.stored_contents(spark, path)
    again = sources.from_compressed_tables(contents, pointers, 30, 25, csr=row)
    np.testing.assert_array_equal(array(again).astype(float), a)
    sources.write_compressed(unary.arithmetic(m, "add", 1.0), f"{tmp_path}/d", row)
    np.testing.assert_array_equal(array(sources.open_compressed(spark, f"{tmp_path}/d")).astype(float), a + 1)
    sources.write_compressed(sources.constant(spark, 3, 2, 0.0), f"{tmp_path}/e", row)
    assert array(sources.open_compressed(spark, f"{tmp_path}/e")).astype(float).sum() == 0


@pytest.mark.parametrize("dtype", ["double", "bigint"])
def test_packed_storage(spark, tmp_path, dtype):
    a = simulate(14, 40, 33, 0.3)
    a = (a * 2**41).astype(np.int64) if dtype == "bigint" else a
    sources.write_packed(coo(spark, a, dtype), f"{tmp_path}/a", (8, 16))
    got = sources.open_packed(spark, f"{tmp_path}/a")
    assert got.dtype == dtype and (array(got) == a).all()
    part = got.narrowed(Selection(9, 5), Selection(0, 33))
    assert "GreaterThanOrEqual(tr,1)" in plan_of(part) and part.count() == np.count_nonzero(a[9:14])
    kinds = {r.value_kind for r in sources.packed_tiles(spark, f"{tmp_path}/a").collect()}
    assert kinds == ({"int64"} if dtype == "bigint" else {"float64"})
    sources.write_packed(unary.arithmetic(coo(spark, np.round(a / 2**41)), "add", 1.0), f"{tmp_path}/b", (8, 16))
    assert {r.value_kind for r in sources.packed_tiles(spark, f"{tmp_path}/b").collect()} == {"int8"}
    assert (array(sources.open_packed(spark, f"{tmp_path}/b")).astype(float) == np.round(a / 2**41) + 1).all()


def test_narrowest_types():
    cases = {"int8": [[], [0.0, -128.0], [5]], "int16": [[200.0]], "int32": [[-40000.0]], "int64": [[2.0**40]], "float32": [[0.5, math.nan, math.inf], [-0.0]], "float64": [[0.1], [1e300]]}
    for kind, values in cases.items():
        for v in values:
            x = np.array(v, np.int64 if v == [5] else float)
            assert narrowest(x) == kind
            np.testing.assert_array_equal(x.astype(kind).astype(float), x.astype(float))


def test_a_fill_across_the_lines_is_not_joined_by_cell(spark, monkeypatch):
    a = simulate(17, 9, 40, 0.2)
    w = np.arange(40.0)
    m = unary.arithmetic(coo(spark, a), "subtract", w, by_row=False)
    for stretch in (65_536, 7):
        monkeypatch.setattr(extract_module, "STRETCH", stretch)
        np.testing.assert_array_equal(array(m).astype(float), a - w)
        assert lines(m.dense_row(5, 20, at=(2, 4))) == {i: (a - w)[i, 5:25].tolist() for i in range(2, 6)}
        assert lines(m.dense_column(2, 5)) == {j: (a - w)[2:7, j].tolist() for j in range(40)}
    monkeypatch.undo()
    plan = plan_of(m.dense_row())
    assert "zip_with" in plan and "posexplode" not in plan
    assert m.dense_row(3, 0).count() == 9 and reshape.subset_block(m, 0, 0, True).dense_row().count() == 0


def test_a_custom_source_is_asked_for_what_is_selected(spark, tmp_path):
    a = simulate(18, 50, 30, 0.4)
    log = str(tmp_path)

    def maker():
        def read(rows, columns):
            import uuid

            with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
                out.write(f"{rows[0]} {rows[1]} {columns[0]} {columns[1]}")
            part = a[rows[0] : rows[0] + rows[1], columns[0] : columns[0] + columns[1]]
            r, c = np.nonzero(part)
            return r + rows[0], c + columns[0], part[r, c]

        return read

    def asked():
        found = sorted(tuple(map(int, (tmp_path / f).read_text().split())) for f in os.listdir(log))
        for f in os.listdir(log):
            (tmp_path / f).unlink()
        return found

    m = sources.from_blocks(spark, maker(), 50, 30, block=20)
    np.testing.assert_array_equal(array(m).astype(float), a)
    assert asked() == [(0, 20, 0, 30), (20, 20, 0, 30), (40, 10, 0, 30)]
    assert lines(m.dense_row(4, 10, at=(25, 5))) == {i: a[i, 4:14].tolist() for i in range(25, 30)}
    assert asked() == [(25, 5, 4, 10)]
    both = reshape.bind([unary.arithmetic(m, "multiply", 2.0), m], True)
    assert lines(both.dense_row(at=[3, 4, 60])) == {3: (2 * a[3]).tolist(), 4: (2 * a[4]).tolist(), 60: a[10].tolist()}
    assert asked() == [(3, 2, 0, 30), (10, 1, 0, 30)]
    assert sources.from_blocks(spark, maker(), 0, 5).entries.count() == 0 and asked() == []


def test_an_oracles_reads_come_in_order(spark):
    a = simulate(15, 40, 6, 0.5)
    wanted = np.random.default_rng(16).integers(0, 40, 700).tolist()
    m = coo(spark, a)
    got = [(r.step, r.i, list(r.x)) for r in deliver(m, True, FixedOracle(wanted), ahead=100)]
    assert got == [(k, i, a[i].tolist()) for k, i in enumerate(wanted)]
    steps = spark.range(500).select(F.col("id").alias("step"), (F.col("id") * 7 % 6).alias("index"))
    assert [(r.step, r.number) for r in deliver(m, False, steps, "sparse", (3, 20), ahead=90)] == [(k, np.count_nonzero(a[3:23, k * 7 % 6])) for k in range(500)]
    assert [r.step for r in deliver(m, True, ConsecutiveOracle(5, 30), ahead=7)] == list(range(30))


def test_sorted_triplets_of_one_long_element(spark):
    rng = np.random.default_rng(13)
    rows = [(2, int(s), float(v)) for s, v in zip(rng.integers(0, 40, 3000), rng.integers(0, 3, 3000), strict=True)] + [(0, 5, 1.0), (4, 0, -1.0), (4, 0, -2.0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small ranges stay apart
    flat, pointers = sources.sorted_triplets(spark.createDataFrame(rows, "primary long, secondary long, v double").repartition(5), 6)
    got = sorted((r.k, r.primary, r["index"], r.v) for r in flat.collect())
    assert got == [(k, *t) for k, t in enumerate(sorted(rows))]
    assert [r.pointer for r in pointers.orderBy("i").collect()] == [0, 1, 1, 3001, 3001, 3003, 3003]
    assert flat.select(F.spark_partition_id().alias("x")).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    flat, pointers = sources.sorted_triplets(spark.createDataFrame([], "primary long, secondary long, v double"), 2)
    assert flat.count() == 0 and pointers.count() == 3
