import math

import numpy as np
import pytest
from gridloom import binary, reshape, sinks, sources, unary
from gridloom.functions import ieee
from gridloom.plans.extract import ConsecutiveOracle, FixedOracle, consecutive, extract, fetch, process_consecutive_indices
from pyspark.sql import functions as F

SPECIAL = [0.0, -0.0, 1.0, -1.0, 2.0, -5.5, 0.5, math.inf, -math.inf, math.nan, 1e300, -3.0]


def simulate(seed, nrow, ncol, density, low=-5, high=5):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((nrow, ncol)) < density, rng.uniform(low, high, (nrow, ncol)), 0.0)
    return np.round(a, 2)


def coo(spark, a, explicit=()):
    rows = [(int(r), int(c), float(a[r, c])) for r, c in zip(*np.nonzero((a != 0) | np.isnan(a)), strict=True)] + [(r, c, 0.0) for r, c in explicit]
    return sources.from_coo(spark.createDataFrame(rows, "r long, c long, v double"), *a.shape)


def dense(spark, a):
    return sources.from_rows(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "i long, x array<double>"), *a.shape)


def array(m):
    out = np.full((m.nrow, m.ncol), -999.0)
    for r in m.cells().collect():
        out[r.r, r.c] = r.v
    return out


def same(got, want):
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)


def np_op(op, a, b):
    with np.errstate(all="ignore"):
        f = {"add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": np.divide, "power": np.power, "integer_divide": lambda x, y: np.floor(np.divide(x, y)), "equal": np.equal, "greater": np.greater, "less": np.less, "greater_or_equal": np.greater_equal, "less_or_equal": np.less_equal, "not_equal": np.not_equal}
        if op == "modulo":
            q, r = np.divide(a, b), np.fmod(a, b)
            return r + np.where((q < 0) & (r != 0), b, 0.0)
        return f[op](a, b).astype(float)


@pytest.mark.parametrize("op", ["add", "subtract", "multiply", "divide", "power", "modulo", "integer_divide"])
def test_arithmetic_on_special_values(spark, op):
    a = np.array([SPECIAL] * len(SPECIAL))
    b = a.T.copy()
    same(array(binary.arithmetic(dense(spark, a), dense(spark, b), op)), np_op(op, a, b))
    small = simulate(3, 6, 7, 0.4)
    for s in (0.0, 2.0, -3.0, math.inf):
        for right in (True, False):
            m = unary.arithmetic(coo(spark, small), op, s, right=right)
            want = np_op(op, small, np.float64(s)) if right else np_op(op, np.full_like(small, s), small)
            same(array(m), want)
            assert m.is_sparse() == bool(np_op(op, *((np.zeros(1), np.float64(s)) if right else (np.full(1, s), np.zeros(1))))[0] == 0)
    for by_row in (True, False):
        w = np.arange(6 if by_row else 7) - 2.0
        wide = w[:, None] if by_row else w[None, :]
        same(array(unary.arithmetic(coo(spark, small), op, w.tolist(), by_row=by_row)), np_op(op, small, np.broadcast_to(wide, small.shape)))


@pytest.mark.parametrize("op", ["equal", "greater", "less", "greater_or_equal", "less_or_equal", "not_equal"])
def test_compare_and_substitute(spark, op):
    a = np.array([SPECIAL] * 2)
    small = simulate(5, 5, 6, 0.5)
    for s in (0.0, 1.0, math.nan):
        same(array(unary.compare(dense(spark, a), op, s)), np_op(op, a, s))
        same(array(unary.compare(coo(spark, small), op, s)), np_op(op, small, s))
        same(array(unary.substitute(coo(spark, small), op, s, 9.0)), np.where(np_op(op, small, s) == 1, 9.0, small))
    w = np.array([-1.0, 0, 1, 2, 0])
    same(array(unary.compare(coo(spark, small), op, w.tolist(), by_row=True)), np_op(op, small, w[:, None]))
    same(array(unary.substitute(coo(spark, small), op, w.tolist(), (w + 7).tolist(), by_row=True)), np.where(np_op(op, small, w[:, None]) == 1, w[:, None] + 7, small))
    other = simulate(6, 5, 6, 0.5)
    same(array(binary.compare(coo(spark, small), coo(spark, other), op)), np_op(op, small, other))


def test_boolean_and_special(spark):
    a, b = simulate(7, 6, 5, 0.4), simulate(8, 6, 5, 0.4)
    a[0, 0] = math.nan
    t, u = a != 0, b != 0
    truth = {"and": np.logical_and, "or": np.logical_or, "xor": np.logical_xor, "equal": np.equal}
    for op, f in truth.items():
        same(array(binary.boolean(coo(spark, a), coo(spark, b), op)), f(t, u))
        for s in (True, False):
            same(array(unary.boolean(coo(spark, a), op, s)), f(t, s))
        w = [True, False, True, True, False]
        same(array(unary.boolean(coo(spark, a), op, w, by_row=False)), f(t, np.array(w)[None, :]))
    same(array(unary.boolean_not(coo(spark, a))), ~t)
    same(array(unary.boolean_cast(coo(spark, a))), t)
    x = np.array([SPECIAL])
    for name, f in {"isnan": np.isnan, "isinf": np.isinf, "isfinite": np.isfinite}.items():
        for ok in (True, False):
            same(array(unary.special_compare(dense(spark, x), name, passes=ok)), f(x) == ok)
            same(array(unary.special_compare(coo(spark, a), name, passes=ok)), f(a) == ok)
        same(array(unary.substitute_special(dense(spark, x), name, 4.0)), np.where(f(x), 4.0, x))


def test_math(spark):
    a = np.array([[x for x in SPECIAL if abs(x) != 1e300]])
    sparse = simulate(9, 5, 5, 0.5)
    away = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
    own = {"abs": np.abs, "sign": np.sign, "log": np.log, "log2": np.log2, "log10": np.log10, "ceiling": np.ceil, "trunc": np.trunc, "round": away, "acos": np.arccos, "acosh": np.arccosh, "asin": np.arcsin, "asinh": np.arcsinh, "atan": np.arctan, "atanh": np.arctanh}
    with np.errstate(all="ignore"):
        for name in unary.ieee.MATH:
            f = own.get(name) or getattr(np, name, None)
            if f is None:
                f = np.vectorize({"gamma": unary.ieee._gamma, "lgamma": unary.ieee._lgamma}[name])
            for x, m in ((a, dense(spark, a)), (sparse, coo(spark, sparse))):
                got = unary.math_function(m, name)
                np.testing.assert_allclose(array(got), f(x), rtol=1e-9, atol=1e-9, err_msg=name)
                assert got.is_sparse() == (m.is_sparse() and unary.ieee.MATH[name][1])
        np.testing.assert_allclose(array(unary.math_function(coo(spark, sparse), "log", 3.0)), np.log(sparse) / np.log(3.0))


def test_chain_keeps_absent_cells_absent(spark):
    a = simulate(11, 40, 30, 0.1)
    m = unary.arithmetic(unary.math_function(unary.arithmetic(coo(spark, a), "add", list(range(40)), by_row=True), "abs"), "multiply", list(range(30)), by_row=False)
    assert m.entries.count() == np.count_nonzero(a) and not m.is_sparse()
    want = np.abs(a + np.arange(40)[:, None]) * np.arange(30)[None, :]
    same(array(m), want)
    same(array(reshape.transpose(m)), want.T)
    same(array(reshape.subset(reshape.transpose(m), [3, 3, 29, 0], True)), want.T[[3, 3, 29, 0]])
    same(array(reshape.subset_block(m, 5, 7, True)), want[5:12])
    same(array(binary.arithmetic(m, coo(spark, a), "divide")), np_op("divide", want, a))
    same(array(reshape.bind([m, coo(spark, a), dense(spark, a)], True)), np.vstack([want, a, a]))


def test_reshape(spark):
    a = simulate(12, 9, 8, 0.3)
    m = coo(spark, a)
    for positions in ([0, 1, 2], [5, 1, 1, 8], [2, 2, 4], [7, 0], []):
        same(array(reshape.subset(m, positions, True)), a[positions] if positions else np.zeros((0, 8)))
    for f, bad in ((reshape.subset_sorted, [2, 1]), (reshape.subset_unique, [1, 1]), (reshape.subset_sorted_unique, [1, 1])):
        with pytest.raises(ValueError, match="subset should be"):
            f(m, bad, True)
    with pytest.raises(IndexError):
        reshape.subset(m, [9], True)
    table = spark.createDataFrame([(0, 4), (1, 4), (2, 0)], "new long, old long")
    same(array(reshape.subset(m, table, False, 3)), a[:, [4, 4, 0]])
    b = reshape.bind([m, dense(spark, a)], False)
    assert b.is_sparse_proportion() == 0.5 and not b.is_sparse() and b.prefer_rows()
    same(array(b), np.hstack([a, a]))
    with pytest.raises(ValueError, match="same number of rows"):
        reshape.bind([m, reshape.transpose(m)], False)
    empty = reshape.bind([], True, spark)
    assert (empty.nrow, empty.ncol, empty.cells().count()) == (0, 0, 0)
    assert reshape.transpose(m).prefer_rows_proportion() == 0.0
    same(array(reshape.cast(reshape.cast(m, "int"), "double")), np.trunc(a))
    with pytest.raises(OverflowError):
        reshape.cast(m.with_(nrow=1000), "double", "byte")
    assert not reshape.forced_dense(m).is_sparse()
    assert fetch(reshape.forced_dense(m), True, 0, "sparse").first().number == np.count_nonzero(a[0])


def test_extraction(spark):
    a = simulate(13, 12, 10, 0.3)
    for m in (coo(spark, a, [(0, 0)] if a[0, 0] == 0 else []), dense(spark, a), unary.arithmetic(unary.arithmetic(coo(spark, a), "add", 1), "subtract", 1)):
        for row in (True, False):
            x = a if row else a.T
            n = x.shape[1]
            for selection, want in ((None, x), ((2, 5), x[:, 2:7]), ([0, 3, 8], x[:, [0, 3, 8]])):
                args = () if selection is None else ((selection[0], selection[1]) if isinstance(selection, tuple) else (selection,))
                got = {r.i: r.x for r in m.dense(row, *args).collect()}
                same(np.array([got[i] for i in range(len(x))]), want)
                keep = range(n) if selection is None else (range(2, 7) if isinstance(selection, tuple) else selection)
                for r in m.sparse_read(row, *args).collect():
                    assert r.number == len(r["index"]) == len(r.value) and set(r["index"]) <= set(keep) and r["index"] == sorted(r["index"])
                    line = np.zeros(n)
                    line[r["index"]] = r.value
                    same(line[list(keep)], x[r.i][list(keep)])
    m = coo(spark, a)
    got = m.sparse_row(sparse_extract_value=False)
    assert got.columns == ["i", "number", "index"]
    assert m.sparse_row(sparse_extract_value=False, sparse_extract_index=False, sparse_ordered_index=False).agg(F.sum("number")).first()[0] == np.count_nonzero(a)
    got = sorted((r.step, r.i, r.x) for r in m.dense_row(oracle=FixedOracle([3, 0, 3])).collect())
    assert [g[:2] for g in got] == [(0, 3), (1, 0), (2, 3)] and got[0][2] == got[2][2] == a[3].tolist()
    assert [r.i for r in sorted(consecutive(m, True, "dense", 4, 3, (1, 2)).collect())] == [4, 5, 6]
    steps = spark.createDataFrame([(0, 5), (1, 2)], "step long, index long")
    assert {r.step: r.number for r in extract(m, "column", "sparse", oracle=steps).collect()} == {0: np.count_nonzero(a[:, 5]), 1: np.count_nonzero(a[:, 2])}
    assert ConsecutiveOracle(4, 3).get(2) == 6 and FixedOracle([1, 2]).total() == 2
    found = []
    process_consecutive_indices([1, 2, 3, 7, 9, 10], lambda s, n: found.append((s, n)))
    assert found == [(1, 3), (7, 1), (9, 2)]
    with pytest.raises(ValueError):
        m.dense_row([3, 1])


def test_sinks(spark):
    a = simulate(14, 11, 7, 0.3)
    zero = next((r, c) for r in range(11) for c in range(7) if a[r, c] == 0)
    sparse = coo(spark, a, [zero])
    for row in (True, False):
        x = a if row else a.T
        n = np.count_nonzero(x, axis=1)
        explicit = zero[0] if row else zero[1]
        with_zero = n + (np.arange(len(x)) == explicit)
        assert [r.n for r in sorted(sinks.count_non_zeros(sparse, row).collect())] == with_zero.tolist()
        assert [r.n for r in sorted(sinks.count_non_zeros(dense(spark, a), row).collect())] == n.tolist()
        got = sorted(sinks.compressed_contents(sparse, row, two_pass=True, num_threads=3).collect())
        assert [r.pointer for r in got] == np.cumsum(with_zero).tolist()
        assert sorted(r.k for r in sinks.fill_compressed(sparse, row).collect()) == list(range(with_zero.sum()))
        same(array(sinks.convert_to_fragmented(sparse, row)), a)
        same(array(sinks.convert_to_compressed(dense(spark, a), row)), a)
        same(array(sinks.convert_to_dense(sparse, row)), a)
        same([r.total for r in sorted(sinks.sums(sparse, row).collect())], x.sum(axis=1))
    empty = coo(spark, np.zeros((0, 4)))
    assert sinks.fragmented_contents(empty, True).count() == 0 and sinks.fragmented_contents(empty, False).count() == 4


def test_sources(spark):
    a = simulate(15, 6, 5, 0.4)
    same(array(sources.constant(spark, 3, 4, 2.5)), np.full((3, 4), 2.5))
    assert sources.constant(spark, 3, 4, 0).is_sparse() and not sources.constant(spark, 3, 4, 1).is_sparse()
    flat = spark.createDataFrame([(k, float(v)) for k, v in enumerate(a.ravel())], "k long, v double")
    same(array(sources.from_flat(flat, 6, 5)), a)
    with pytest.raises(ValueError, match="product"):
        sources.from_flat(flat, 6, 4)
    with pytest.raises(ValueError, match="product"):
        dense(spark, a).with_() and sources.from_rows(spark.createDataFrame([(0, [1.0])], "i long, x array<double>"), 2, 1)
    r, c = np.nonzero(a)
    pointers = np.concatenate([[0], np.cumsum(np.count_nonzero(a, axis=1))]).tolist()
    same(array(sources.from_compressed(spark, a[r, c].tolist(), c.tolist(), pointers, 6, 5)), a)
    for values, indices, ps, message in (([1.0], [0, 1], [0, 2], "same length"), ([1.0], [0], [0, 1, 1], "equal to the primary"), ([1.0], [0], [1, 1], "zero"), ([1.0], [0], [0, 0], "last element"), ([1.0], [5], [0, 1], "less than"), ([1.0, 2.0], [1, 1], [0, 2], "strictly increasing")):
        with pytest.raises(ValueError, match=message):
            sources.from_compressed(spark, values, indices, ps, 1, 2)
    lists = lambda rows: spark.createDataFrame(rows, "i long, index array<long>, value array<double>")
    for rows, message in (([(0, [1], [1.0, 2.0])], "same"), ([(0, [9], [1.0])], "less than"), ([(0, [1, 0], [1.0, 2.0])], "strictly"), ([(7, [1], [1.0])], "primary")):
        with pytest.raises(ValueError, match=message):
            sources.from_fragmented(lists(rows), 2, 3)
    triplets = spark.createDataFrame([(1, 2, 5.0), (0, 1, 2.0), (1, 0, 3.0), (1, 2, 4.0)], "primary long, secondary long, v double")
    arrays, pointers = sources.compress_triplets(triplets, 3)
    assert [(x["index"], x.value) for x in sorted(arrays.collect())] == [([1], [2.0]), ([0, 2, 2], [3.0, 4.0, 5.0]), ([], [])]
    assert [p.pointer for p in sorted(pointers.collect())] == [0, 1, 4, 4]
    with pytest.raises(ValueError, match="strictly increasing"):
        sources.from_triplets(triplets, 3, 3)
    assert array(sources.from_triplets(triplets, 3, 3, combine="sum"))[1, 2] == 9.0


def test_custom_helpers(spark):
    a = simulate(16, 5, 4, 0.5)
    m = coo(spark, a)
    same(array(unary.custom(m, unary.Helper(lambda v, r, c: v * r + c, depends_on_row=True, depends_on_column=True))), a * np.arange(5)[:, None] + np.arange(4))
    same(array(unary.custom(m, unary.Helper(lambda v, r, c: v * r, keeps_zero=True))), a * np.arange(5)[:, None])
    with pytest.raises(ValueError, match="dimensions"):
        unary.custom(m, unary.Helper(lambda v, r, c: v, nrow=4))
    same(array(binary.combine(m, m, binary.BinaryHelper(lambda x, y, r, c: x + y + 1))), a + a + 1)
    with pytest.raises(ValueError, match="shape"):
        binary.arithmetic(m, reshape.transpose(m), "add")


def test_selections_reach_the_source(spark, tmp_path):
    spark.range(1000).selectExpr("id div 10 as r", "id % 10 as c", "cast(id as double) as v").write.parquet(f"{tmp_path}/coo")
    m = sources.from_coo(spark.read.parquet(f"{tmp_path}/coo"), 100, 10)
    plan = reshape.transpose(unary.arithmetic(binary.arithmetic(m, m, "add"), "multiply", 2.0)).sparse_column(at=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(r,5)") + plan.count("EqualTo(r,5)") >= 1


def test_stream_of_entries(spark, tmp_path):
    from gridloom.streaming import for_each_batch

    spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0)], "r long, c long, v double").write.parquet(f"{tmp_path}/in")
    seen = []
    query = for_each_batch(spark.readStream.schema("r long, c long, v double").parquet(f"{tmp_path}/in"), 3, 2, lambda m, k: seen.extend(sorted(tuple(r) for r in unary.arithmetic(m, "multiply", 2.0).entries.collect()))).option("checkpointLocation", f"{tmp_path}/at").start()
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, 1, 10.0), (2, 0, 2.0)]


def test_vector_tables_are_validated(spark):
    m = coo(spark, simulate(3, 3, 2, 0.9))
    table = lambda rows: spark.createDataFrame(rows, "i long, w double")
    good = [(0, 1.0), (2, 3.0), (1, 2.0)]
    assert array(unary.arithmetic(m, "add", table(good), by_row=True)).shape == (3, 2)
    for rows in (good[:2], [*good, (1, 5.0)], [(0, 1.0), (0, 1.0), (0, 1.0)], [(0, 1.0), (1, 2.0), (3, 3.0)], [(0, 1.0), (1, None), (2, 3.0)], [(0, 1.0), (1, 2.0), (-1, 3.0)], []):
        for use in (lambda t: unary.arithmetic(m, "add", t, by_row=True), lambda t: unary.compare(m, "less", t, by_row=True), lambda t: unary.boolean(m, "or", t, by_row=True), lambda t: unary.substitute(m, "less", t.selectExpr("i", "w as compared", "w as substitute"), by_row=True)):
            with pytest.raises(ValueError, match="vector's table"):
                use(table(rows))
    assert unary.arithmetic(m, "add", table(good[:2]), by_row=True, check=False).nrow == 3
    assert array(unary.arithmetic(coo(spark, np.zeros((0, 2))), "add", table([]), by_row=True)).shape == (0, 2)


def test_functions_keep_twelve_digits(spark):
    x = [1e-300, 1e-10, 1e-3, 0.3, 0.5, 1.0, 1 + 1e-9, 1.5, 2.0, 2.4, 3.0, 7.25, 29.0, 100.5, 170.0, 1e6, 2.0**29, 2.0**-1074, 1e300]
    x += [-v for v in x if v != 1e300]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    rows = df.select("x", ieee.asinh(F.col("x")), ieee.log2(F.col("x")), ieee.gamma(F.col("x")), ieee.lgamma(F.col("x"))).collect()

    def whole(v):
        return v == math.floor(v)

    for v, a, b, g, lg in rows:
        assert a == pytest.approx(math.asinh(v), rel=1e-12, abs=0)
        if v > 0:
            assert b == pytest.approx(math.log2(v), rel=1e-12, abs=0) and (not whole(math.log2(v)) or b == math.log2(v))
        if v < 0 and whole(v):
            assert math.isnan(g) and lg == math.inf
            continue
        try:
            assert g == pytest.approx(math.gamma(v), rel=1e-12, abs=0)
        except OverflowError:
            assert g == math.copysign(math.inf, v)
        assert lg == pytest.approx(math.lgamma(v), rel=1e-12, abs=5e-15)
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (0.0,), (-0.0,)], "x double").select(ieee.asinh(F.col("x")), ieee.gamma(F.col("x")), ieee.lgamma(F.col("x"))).collect()
    assert [str(tuple(r)) for r in odd] == ["(nan, nan, nan)", "(inf, inf, inf)", "(-inf, nan, inf)", "(0.0, inf, inf)", "(-0.0, -inf, inf)"]


def test_lines_in_stretches(spark, monkeypatch):
    from gridloom.plans import extract as reads
    from gridloom.plans import sinks as writes

    monkeypatch.setattr(reads, "STRETCH", 4)
    monkeypatch.setattr(writes, "STRETCH", 4)
    a = simulate(21, 9, 13, 0.3)
    weights = [float(k) for k in range(13)]
    m = unary.arithmetic(unary.arithmetic(coo(spark, a), "add", weights, by_row=False), "multiply", 2.0)
    want = (a + np.array(weights)) * 2
    same(array(m), want)
    for row in (True, False):
        got = {r.i: r.x for r in m.dense(row, 1, 7).collect()}
        assert all(np.allclose(got[k], (want if row else want.T)[k, 1:8]) for k in got) and len(got) == (9 if row else 13)
        got = {r.i: r.x for r in m.dense(row, [0, 5, 6]).collect()}
        assert all(np.allclose(got[k], (want if row else want.T)[k, [0, 5, 6]]) for k in got)
        same([r.total for r in sorted(sinks.sums(m, row).collect())], want.sum(axis=1 if row else 0))
        assert [r.n for r in sorted(sinks.count_non_zeros(m, row).collect())] == np.count_nonzero(want, axis=1 if row else 0).tolist()
        flat = a if row else a.T
        p, q = np.nonzero(flat)
        assert [(r.p, r.s, r.v) for r in sorted(sinks.fill_compressed(coo(spark, a), row).collect(), key=lambda r: r.k)] == [(i, j, flat[i, j]) for i, j in zip(p, q)]
    same(array(unary.arithmetic(coo(spark, a), "add", 1.0)), a + 1)
    infinite = unary.arithmetic(coo(spark, a), "add", float("inf"))
    assert all(np.isinf(r.total) for r in sinks.sums(infinite).collect())


def test_compressed_tables(spark, monkeypatch):
    from gridloom.sources import leaves

    monkeypatch.setattr(leaves, "SPAN", 3)
    a = simulate(31, 8, 6, 0.5)
    a[2:4] = 0
    for csr in (True, False):
        flat = a if csr else a.T
        p, q = np.nonzero(flat)
        contents = [(k, int(j), float(flat[i, j])) for k, (i, j) in enumerate(zip(p, q))]
        pointers = [(i, int(x)) for i, x in enumerate(np.concatenate([[0], np.cumsum(np.count_nonzero(flat, axis=1))]))]
        make = lambda c, t, csr=csr, check=True: sources.from_compressed_tables(spark.createDataFrame(c, "k long, index long, v double").repartition(3), spark.createDataFrame(t, "i long, pointer long"), 8, 6, csr=csr, check=check)
        same(array(make(contents, pointers)), a)
        same(array(make(contents, pointers, check=False)), a)
        k = int(np.flatnonzero(p[1:] == p[:-1])[0])
        bad = contents.copy()
        bad[k + 1] = (k + 1, contents[k][1], 1.0)
        for c, t, message in ((bad, pointers, "strictly increasing"), (contents[:-1], pointers, "last element"), ([*contents[:-1], (len(contents) - 1, 99, 1.0)], pointers, "less than"), (contents, pointers[:-1], "primary"), (contents, [(0, 1), *pointers[1:]], "zero"), (contents, [pointers[0], (1, len(contents)), *pointers[2:]], "decrease"), ([*contents[:-1], (len(contents) + 5, 0, 1.0)], pointers, "places")):
            with pytest.raises(ValueError, match=message):
                make(c, t)
    assert sources.from_compressed(spark, [], [], [0, 0], 1, 2).entries.count() == 0


def test_transposed_buffers(spark):
    a = simulate(41, 3, 4, 1.0)
    padded = np.full((3, 6), -1.0)
    padded[:, :4] = a
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(padded.ravel())], "k long, v double")
    out = np.full(4 * 5, -1.0)
    for r in reshape.transpose_buffer(df, 3, 4, 6, 5).collect():
        out[r.k] = r.v
    want = np.full((4, 5), -1.0)
    want[:, :3] = a.T
    same(out.reshape(4, 5), want)
    with pytest.raises(ValueError):
        reshape.transpose_buffer(df, 3, 4, 3)


def test_positional_binary_helpers_follow_reshapes(spark):
    a, b = simulate(51, 4, 5, 0.3), simulate(52, 4, 5, 0.3)
    m = binary.combine(coo(spark, a), coo(spark, b), binary.BinaryHelper(lambda x, y, r, c: x + y + r * 10 + c))
    want = a + b + np.arange(4)[:, None] * 10 + np.arange(5)
    same(array(reshape.transpose(m)), want.T)
    same(array(reshape.subset(m, [3, 1], True)), want[[3, 1]])
