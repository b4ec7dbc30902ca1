"""Queries over the driver's tables, each with the DuckDB SQL of the same rows.

Matrices: S, order by supplier (quantities, sparse); C and C2, customer by month (order
counts less a constant, so with explicit zeros and negatives); E, embeddings (dense).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, reshape, sinks, sources, unary
from .functions.arrays import of_cells, of_pairs
from .matrix import Matrix
from .operators import blocks
from .plans.extract import ConsecutiveOracle, FixedOracle, consecutive, fetch
from .scratch import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def S(spark: SparkSession, sf: str) -> Matrix:
    df = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("r"), F.col("l_suppkey").alias("c")).agg(F.sum("l_quantity").alias("v"))
    return sources.from_coo(df, _read(spark, sf, "orders").count(), _read(spark, sf, "supplier").count())


def C(spark: SparkSession, sf: str, status: str | None = None, less: int = 2) -> Matrix:
    orders = _read(spark, sf, "orders")
    orders = orders if status is None else orders.where(F.col("o_orderstatus") == status)
    df = orders.groupBy(F.col("o_custkey").alias("r"), (F.month("o_orderdate") - 1).alias("c")).agg((F.count("*") - less).cast("double").alias("v"))
    return sources.from_coo(df, _read(spark, sf, "customer").count(), 12)


def C2(spark: SparkSession, sf: str) -> Matrix:
    return C(spark, sf, "F", 1)


def E(spark: SparkSession, sf: str) -> Matrix:
    df = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x"))
    return sources.from_rows(df, df.count(), 64, check=False)


S_SQL = "s AS (SELECT l_orderkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
C_SQL = "c AS (SELECT o_custkey AS r, CAST(month(o_orderdate) - 1 AS BIGINT) AS c, CAST(count(*) - 2 AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"
C2_SQL = "c2 AS (SELECT o_custkey AS r, CAST(month(o_orderdate) - 1 AS BIGINT) AS c, CAST(count(*) - 1 AS DOUBLE) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)"
CELLS_SQL = "k AS (SELECT r, c FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS r) CROSS JOIN (SELECT unnest(range(12)) AS c))"
G_SQL = f"{C_SQL}, {CELLS_SQL}, g AS (SELECT k.r, k.c, coalesce(c.v, 0.0) AS v FROM k LEFT JOIN c ON c.r = k.r AND c.c = k.c)"
G2_SQL = f"{G_SQL}, {C2_SQL}, g2 AS (SELECT g.r, g.c, g.v AS a, coalesce(c2.v, 0.0) AS b FROM g LEFT JOIN c2 ON c2.r = g.r AND c2.c = g.c)"
E_SQL = "e AS (SELECT vec_id AS r, CAST(unnest(range(len(embedding))) AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _plain(v: str) -> str:
    return f"CASE WHEN ({v}) = 0 THEN 0.0 ELSE CAST(({v}) AS DOUBLE) END"


def _cells(m: Matrix, digits: int | None = None) -> DataFrame:
    """All cells; -0.0 as 0.0."""
    v = F.col("v").cast("double")
    v = v if digits is None else F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.round(v, digits))
    return m.cells().select("r", "c", F.when(v == 0, F.lit(0.0)).otherwise(v).alias("v"))


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


ARITHMETIC_SQL = {
    "add": "{a} + {b}",
    "subtract": "{a} - {b}",
    "multiply": "{a} * {b}",
    "divide": "{a} / {b}",
    "power": "pow({a}, {b})",
    "modulo": "CASE WHEN {b} = 0 THEN CAST('nan' AS DOUBLE) ELSE {a} % {b} + CASE WHEN {a} / {b} < 0 AND {a} % {b} <> 0 THEN {b} ELSE 0 END END",
    "integer_divide": "floor({a} / {b})",
}
COMPARE_SQL = {"equal": "=", "greater": ">", "less": "<", "greater_or_equal": ">=", "less_or_equal": "<=", "not_equal": "<>"}
BOOLEAN_SQL = {"and": "({a} <> 0) AND ({b} <> 0)", "or": "({a} <> 0) OR ({b} <> 0)", "xor": "({a} <> 0) <> ({b} <> 0)", "equal": "({a} <> 0) = ({b} <> 0)"}
MONTHS = [float(x) for x in (1, -2, 3, 0.5, 2, -1, 4, 1, 5, -3, 2, 6)]
MONTHS_SQL = "list_extract([" + ", ".join(map(str, MONTHS)) + "]::DOUBLE[], c + 1)"
MIXED = [0.0, 1.0, -1.0, 2.0, 0.0, 1.0, 3.0, -2.0, 0.0, 1.0, 2.0, -1.0]
MIXED_SQL = "list_extract([" + ", ".join(map(str, MIXED)) + "]::DOUBLE[], c + 1)"


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_nationkey") - 5).cast("double").alias("w"))


N_SQL = f"{G_SQL}, n AS (SELECT g.r, g.c, g.v, CAST(c_nationkey - 5 AS DOUBLE) AS w FROM g JOIN customer ON c_custkey = g.r)"


def _arithmetic() -> None:
    for op, sql in ARITHMETIC_SQL.items():
        value = sql.format(a="v", b="3.0")
        _add(f"arithmetic_scalar_{op}", lambda s, d, op=op: _cells(unary.arithmetic(C(s, d), op, 3.0)), f"WITH {G_SQL} SELECT r, c, {_plain(value)} AS v FROM g")
        if op not in ("add", "multiply"):
            value = sql.format(a="3.0", b="v")
            _add(f"arithmetic_scalar_left_{op}", lambda s, d, op=op: _cells(unary.arithmetic(C(s, d), op, 3.0, right=False)), f"WITH {G_SQL} SELECT r, c, {_plain(value)} AS v FROM g")
        value = sql.format(a="v", b="w")
        _add(f"arithmetic_row_vector_{op}", lambda s, d, op=op: _cells(unary.arithmetic(C(s, d), op, _nations(s, d), by_row=True), 9), f"WITH {N_SQL} SELECT r, c, round({_plain(value)}, 9) AS v FROM n")
        value = sql.format(a="v", b=MONTHS_SQL)
        _add(f"arithmetic_column_vector_{op}", lambda s, d, op=op: _cells(unary.arithmetic(C(s, d), op, MONTHS, by_row=False), 9), f"WITH {G_SQL} SELECT r, c, round({_plain(value)}, 9) AS v FROM g")
        value = sql.format(a="a", b="b")
        _add(f"binary_arithmetic_{op}", lambda s, d, op=op: _cells(binary.arithmetic(C(s, d), C2(s, d), op), 9), f"WITH {G2_SQL} SELECT r, c, round({_plain(value)}, 9) AS v FROM g2")
    _add(
        "arithmetic_sparse_by_supplier",
        lambda s, d: unary.arithmetic(S(s, d), "multiply", _read(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("w")), by_row=False).entries,
        f"WITH {S_SQL} SELECT r, c, v * s_nationkey AS v FROM s JOIN supplier ON s_suppkey = c",
    )
    _add(
        "binary_sparse_add",
        lambda s, d: binary.arithmetic(S(s, d), unary.arithmetic(S(s, d), "multiply", 2.0), "add").entries,
        f"WITH {S_SQL} SELECT r, c, v * 3 AS v FROM s",
    )


def _comparisons() -> None:
    flag = "CASE WHEN {} THEN 1.0 ELSE 0.0 END"
    for op, sign in COMPARE_SQL.items():
        _add(f"compare_scalar_{op}", lambda s, d, op=op: _cells(unary.compare(C(s, d), op, 1.0)), f"WITH {G_SQL} SELECT r, c, CAST({flag.format(f'v {sign} 1')} AS DOUBLE) AS v FROM g")
        _add(f"compare_vector_{op}", lambda s, d, op=op: _cells(unary.compare(C(s, d), op, MIXED, by_row=False)), f"WITH {G_SQL} SELECT r, c, CAST({flag.format(f'v {sign} {MIXED_SQL}')} AS DOUBLE) AS v FROM g")
        _add(f"binary_compare_{op}", lambda s, d, op=op: _cells(binary.compare(C(s, d), C2(s, d), op)), f"WITH {G2_SQL} SELECT r, c, CAST({flag.format(f'a {sign} b')} AS DOUBLE) AS v FROM g2")
        _add(f"substitute_scalar_{op}", lambda s, d, op=op: _cells(unary.substitute(C(s, d), op, 1.0, -7.0)), f"WITH {G_SQL} SELECT r, c, CAST(CASE WHEN v {sign} 1 THEN -7.0 ELSE v END AS DOUBLE) AS v FROM g")
        _add(f"substitute_vector_{op}", lambda s, d, op=op: _cells(unary.substitute(C(s, d), op, MIXED, MONTHS, by_row=False)), f"WITH {G_SQL} SELECT r, c, CAST(CASE WHEN v {sign} {MIXED_SQL} THEN {MONTHS_SQL} ELSE v END AS DOUBLE) AS v FROM g")
    odd = {"isnan": "isnan(v / 0)", "isinf": "isinf(v / 0)", "isfinite": "isfinite(v / (v - 1))"}
    made = {"isnan": lambda m: unary.arithmetic(m, "divide", 0.0), "isinf": lambda m: unary.arithmetic(m, "divide", 0.0), "isfinite": lambda m: binary.arithmetic(m, unary.arithmetic(m, "subtract", 1.0), "divide")}
    inner = {"isnan": "v / 0", "isinf": "v / 0", "isfinite": "v / (v - 1)"}
    for test, sql in odd.items():
        for ok in (True, False):
            _add(
                f"{'' if ok else 'not_'}{test}",
                lambda s, d, test=test, ok=ok: _cells(unary.special_compare(made[test](C(s, d)), test, passes=ok)),
                f"WITH {G_SQL} SELECT r, c, CAST({flag.format(sql if ok else f'NOT {sql}')} AS DOUBLE) AS v FROM g",
            )
        _add(
            f"substitute_{test}",
            lambda s, d, test=test: _cells(unary.substitute_special(made[test](C(s, d)), test, 5.0), 9),
            f"WITH {G_SQL} SELECT r, c, round({_plain(f'CASE WHEN {sql} THEN 5.0 ELSE {inner[test]} END')}, 9) AS v FROM g",
        )
    for op, sql in BOOLEAN_SQL.items():
        for value in (True, False):
            _add(f"boolean_scalar_{op}_{str(value).lower()}", lambda s, d, op=op, value=value: _cells(unary.boolean(C(s, d), op, value)), f"WITH {G_SQL} SELECT r, c, CAST({flag.format(sql.format(a='v', b=int(value)))} AS DOUBLE) AS v FROM g")
        _add(f"boolean_vector_{op}", lambda s, d, op=op: _cells(unary.boolean(C(s, d), op, MIXED, by_row=False)), f"WITH {G_SQL} SELECT r, c, CAST({flag.format(sql.format(a='v', b=MIXED_SQL))} AS DOUBLE) AS v FROM g")
        _add(f"binary_boolean_{op}", lambda s, d, op=op: _cells(binary.boolean(C(s, d), C2(s, d), op)), f"WITH {G2_SQL} SELECT r, c, CAST({flag.format(sql.format(a='a', b='b'))} AS DOUBLE) AS v FROM g2")
    _add("boolean_not", lambda s, d: _cells(unary.boolean_not(C(s, d))), f"WITH {G_SQL} SELECT r, c, CAST({flag.format('v = 0')} AS DOUBLE) AS v FROM g")
    _add("boolean_cast", lambda s, d: _cells(unary.boolean_cast(C(s, d))), f"WITH {G_SQL} SELECT r, c, CAST({flag.format('v <> 0')} AS DOUBLE) AS v FROM g")


def _functions() -> None:
    guarded = {
        "sign": "sign(v)",
        "ceiling": "ceil(v)",
        "log": "CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END",
        "log2": "CASE WHEN v > 0 THEN log2(v) WHEN v = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END",
        "log10": "CASE WHEN v > 0 THEN log10(v) WHEN v = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END",
        "log1p": "CASE WHEN v > -1 THEN ln(1 + v) WHEN v = -1 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END",
        "sqrt": "CASE WHEN v >= 0 THEN sqrt(v) ELSE CAST('nan' AS DOUBLE) END",
        "acosh": "CASE WHEN v >= 1 THEN acosh(v) ELSE CAST('nan' AS DOUBLE) END",
        "round": "sign(v) * floor(abs(v) + 0.5)",
        "trunc": "sign(v) * floor(abs(v))",
        "expm1": "exp(v) - 1",
        "gamma": "gamma(v)",
        "lgamma": "lgamma(v)",
    }
    for name in unary.ieee.MATH:
        sql = guarded.get(name, f"{name}(v)")
        whole = name in ("ceiling", "floor", "trunc", "round", "sign")  # on four times the value, else all is 0 or 1
        positive = name in ("gamma", "lgamma")  # of the distance from zero and a half

        above = name == "acosh"  # from one on

        def matrix(s: SparkSession, d: str, whole=whole, positive=positive, above=above) -> Matrix:
            m = E(s, d)
            if above:
                return unary.arithmetic(unary.math_function(m, "abs"), "add", 1.0)
            if positive:
                return unary.arithmetic(unary.math_function(m, "abs"), "add", 0.5)
            return unary.arithmetic(m, "multiply", 4.0) if whole else m

        inner = "SELECT r, c, v * 4 AS v FROM e" if whole else "SELECT r, c, abs(v) + 0.5 AS v FROM e" if positive else "SELECT r, c, abs(v) + 1 AS v FROM e" if above else "SELECT * FROM e"
        _add(f"math_{name}", lambda s, d, name=name, matrix=matrix: _cells(unary.math_function(matrix(s, d), name), 9), f"WITH {E_SQL}, x AS ({inner}) SELECT r, c, {_plain(f'round({sql}, 9)')} AS v FROM x")
    ln = guarded["log"]
    _add("math_log_base_3", lambda s, d: _cells(unary.math_function(E(s, d), "log", 3.0), 6), f"WITH {E_SQL} SELECT r, c, {_plain(f'round(({ln}) / ln(3.0), 6)')} AS v FROM e")
    _add("math_sparse_sqrt", lambda s, d: _rounded(unary.math_function(S(s, d), "sqrt").entries, 6), f"WITH {S_SQL} SELECT r, c, round(sqrt(v), 6) AS v FROM s")
    _add("math_chain", lambda s, d: _cells(unary.math_function(unary.arithmetic(unary.math_function(C(s, d), "exp"), "add", MONTHS, by_row=False), "abs"), 6), f"WITH {G_SQL} SELECT r, c, {_plain(f'round(abs(exp(v) + {MONTHS_SQL}), 6)')} AS v FROM g")


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("v", F.round("v", digits))


def _shapes() -> None:
    picks = {"subset_any": [5, 2, 5, 11, 0], "subset_sorted": [0, 2, 2, 7], "subset_unique": [9, 3, 4], "subset_sorted_unique": [1, 4, 10], "subset_consecutive": [3, 4, 5, 6]}
    made = {"subset_sorted": reshape.subset_sorted, "subset_unique": reshape.subset_unique, "subset_sorted_unique": reshape.subset_sorted_unique}
    for name, listed in picks.items():
        pairs = ", ".join(f"({k}, {x})" for k, x in enumerate(listed))
        _add(name, lambda s, d, name=name, listed=listed: _cells(made.get(name, reshape.subset)(C(s, d), listed, False)), f"WITH {G_SQL}, p(n, o) AS (VALUES {pairs}) SELECT r, CAST(n AS BIGINT) AS c, v FROM g JOIN p ON g.c = p.o")

    def reversed_rows(s: SparkSession, d: str) -> DataFrame:
        m = C(s, d)
        return _cells(reshape.subset(m, s.range(m.nrow).select(F.col("id").alias("new"), (F.lit(m.nrow - 1) - F.col("id")).alias("old")), True, m.nrow))

    _add("subset_by_table", reversed_rows, f"WITH {G_SQL} SELECT (SELECT count(*) FROM customer) - 1 - r AS r, c, v FROM g")
    _add("subset_block", lambda s, d: reshape.subset_block(S(s, d), 3, 5, False).entries, f"WITH {S_SQL} SELECT r, c - 3 AS c, v FROM s WHERE c >= 3 AND c < 8")
    _add("transpose", lambda s, d: reshape.transpose(S(s, d)).entries, f"WITH {S_SQL} SELECT c AS r, r AS c, v FROM s")
    _add("bind_rows", lambda s, d: _cells(reshape.bind([C(s, d), unary.arithmetic(C2(s, d), "add", 1.0)], True)), f"WITH {G2_SQL} SELECT r, c, a AS v FROM g2 UNION ALL SELECT r + (SELECT count(*) FROM customer), c, b + 1 FROM g2")
    _add("bind_columns", lambda s, d: reshape.bind([C(s, d), C2(s, d), C(s, d)], False).entries, f"WITH {C_SQL}, {C2_SQL} SELECT * FROM c UNION ALL SELECT r, c + 12, v FROM c2 UNION ALL SELECT r, c + 24, v FROM c")
    _add("cast_int", lambda s, d: reshape.cast(unary.arithmetic(S(s, d), "multiply", 0.3), "int").entries, f"WITH {S_SQL} SELECT r, c, CAST(trunc(v * 0.3) AS INTEGER) AS v FROM s")
    _add("cast_float", lambda s, d: reshape.cast(S(s, d), "float").entries.withColumn("v", F.col("v").cast("double")), f"WITH {S_SQL} SELECT r, c, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM s")
    _add("forced_dense", lambda s, d: _cells(reshape.forced_dense(C(s, d))), f"WITH {G_SQL} SELECT r, c, v FROM g")
    _add("constant", lambda s, d: _cells(sources.constant(s, _read(s, d, "customer").count(), 12, 2.5)), f"WITH {CELLS_SQL} SELECT r, c, CAST(2.5 AS DOUBLE) AS v FROM k")
    _add("custom_unary", lambda s, d: _cells(unary.custom(C(s, d), unary.Helper(lambda v, r, c: v * 2 + c, depends_on_column=True))), f"WITH {G_SQL} SELECT r, c, CAST(v * 2 + c AS DOUBLE) AS v FROM g")
    _add("custom_binary", lambda s, d: _cells(binary.combine(C(s, d), C2(s, d), binary.BinaryHelper(lambda a, b, r, c: F.greatest(a, b) + 1))), f"WITH {G2_SQL} SELECT r, c, CAST(greatest(a, b) + 1 AS DOUBLE) AS v FROM g2")


def _text(x: str) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("bigint").cast("string")), ",")


def _shown(df: DataFrame) -> DataFrame:
    """Arrays of whole numbers as text."""
    arrays = {c: _text(c) for c, t in df.dtypes if t.startswith("array")}
    return df.withColumns(arrays)


def _reads() -> None:
    joined = "string_agg(CAST(CAST({v} AS BIGINT) AS VARCHAR), ',' ORDER BY {o})"
    for row in (True, False):
        t, o, side = ("r", "c", "row") if row else ("c", "r", "column")
        blocks = {"full": ((), "true"), "block": (((2, 6) if row else (10, 40)), f"{o} >= {2 if row else 10} AND {o} < {8 if row else 50}"), "index": (([0, 3, 4, 9],), f"{o} IN (0, 3, 4, 9)")}
        for kind, (args, where) in blocks.items():
            _add(f"dense_{side}_{kind}", lambda s, d, row=row, args=args: _shown(C(s, d).dense(row, *args)), f"WITH {G_SQL} SELECT {t} AS i, {joined.format(v='v', o=o)} AS x FROM g WHERE {where} GROUP BY 1")
            every = f"(SELECT unnest(range({'(SELECT count(*) FROM customer)' if row else '12'})) AS i)"
            _add(
                f"sparse_{side}_{kind}",
                lambda s, d, row=row, args=args: _shown(C(s, d).sparse_read(row, *args)),
                f"WITH {C_SQL}, q AS (SELECT {t} AS i, count(*) AS number, {joined.format(v=o, o=o)} AS \"index\", {joined.format(v='v', o=o)} AS \"value\" FROM c WHERE {where} GROUP BY 1) "
                f'SELECT a.i, coalesce(number, 0) AS number, coalesce("index", \'\') AS "index", coalesce("value", \'\') AS "value" FROM {every} a LEFT JOIN q ON a.i = q.i',
            )
        p = "customer" if row else None
        extent = f"(SELECT count(*) FROM {p})" if p else "12"
        _add(f"fragmented_{side}", lambda s, d, row=row: _shown(sinks.fragmented_contents(C(s, d), row)), f"WITH {C_SQL}, q AS (SELECT {t} AS i, {joined.format(v=o, o=o)} AS x, {joined.format(v='v', o=o)} AS y FROM c GROUP BY 1) SELECT a.i, coalesce(x, '') AS \"index\", coalesce(y, '') AS \"value\" FROM (SELECT unnest(range({extent})) AS i) a LEFT JOIN q ON a.i = q.i")
        _add(
            f"compressed_{side}",
            lambda s, d, row=row: _shown(sinks.compressed_contents(C(s, d), row)),
            f"WITH {C_SQL}, q AS (SELECT {t} AS i, count(*) AS n, {joined.format(v=o, o=o)} AS x, {joined.format(v='v', o=o)} AS y FROM c GROUP BY 1) SELECT a.i, coalesce(x, '') AS \"index\", coalesce(y, '') AS \"value\", CAST(sum(coalesce(n, 0)) OVER (ORDER BY a.i) AS BIGINT) AS pointer FROM (SELECT unnest(range({extent})) AS i) a LEFT JOIN q ON a.i = q.i",
        )
        _add(f"count_structural_{side}", lambda s, d, row=row: sinks.count_non_zeros(C(s, d), row), f"WITH {G_SQL} SELECT g.{t} AS i, count(c.v) AS n FROM g LEFT JOIN c ON c.r = g.r AND c.c = g.c GROUP BY 1")
        _add(f"count_non_zeros_{side}", lambda s, d, row=row: sinks.count_non_zeros(unary.arithmetic(C(s, d), "add", 1.0), row), f"WITH {G_SQL} SELECT {t} AS i, count(*) FILTER (WHERE v + 1 <> 0) AS n FROM g GROUP BY 1")
        _add(f"to_dense_{side}", lambda s, d, row=row: _shown(sinks.to_dense(unary.arithmetic(C(s, d), "multiply", 3.0), row)), f"WITH {G_SQL} SELECT {t} AS i, {joined.format(v='v * 3', o=o)} AS x FROM g GROUP BY 1")
        _add(f"{side}_sums", lambda s, d, row=row: sinks.sums(unary.arithmetic(C(s, d), "add", 1.0), row), f"WITH {G_SQL} SELECT {t} AS i, sum(v + 1) AS total FROM g GROUP BY 1")
        _add(f"round_trip_{side}", lambda s, d, row=row: sinks.convert_to_dense(sinks.convert_to_compressed(sinks.convert_to_fragmented(C(s, d), row), row), row).cells(), f"WITH {G_SQL} SELECT r, c, v FROM g")
        _add(f"fetch_{side}", lambda s, d, row=row: _shown(fetch(C(s, d), row, 7)), f"WITH {G_SQL} SELECT {t} AS i, {joined.format(v='v', o=o)} AS x FROM g WHERE {t} = 7 GROUP BY 1")
        _add(
            f"oracle_dense_{side}",
            lambda s, d, row=row: _shown(C(s, d).dense(row, oracle=FixedOracle([4, 1, 4, 0]))),
            f"WITH {G_SQL}, p(step, i) AS (VALUES (0, 4), (1, 1), (2, 4), (3, 0)), q AS (SELECT {t} AS i, {joined.format(v='v', o=o)} AS x FROM g GROUP BY 1) SELECT CAST(step AS BIGINT) AS step, q.i, x FROM p JOIN q ON p.i = q.i",
        )
        _add(
            f"oracle_sparse_{side}",
            lambda s, d, row=row: consecutive(C(s, d), row, "sparse", 2, 6, sparse_extract_index=False, sparse_extract_value=False),
            f"WITH {G_SQL} SELECT g.{t} - 2 AS step, g.{t} AS i, count(c.v) AS number FROM g LEFT JOIN c ON c.r = g.r AND c.c = g.c WHERE g.{t} >= 2 AND g.{t} < 8 GROUP BY 1, 2",
        )
    _add(
        "fill_compressed",
        lambda s, d: sinks.fill_compressed(C(s, d), True),
        f"WITH {C_SQL} SELECT r AS p, c AS s, v, row_number() OVER (ORDER BY r, c) - 1 AS k FROM c",
    )
    triplets = "SELECT CAST(c_nationkey AS BIGINT) AS p, o_custkey % 7 AS s, CAST(c_nationkey + o_custkey % 5 AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey"

    def triple(s: SparkSession, d: str) -> DataFrame:
        joined = _read(s, d, "orders").join(_read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(F.col("c_nationkey").cast("long").alias("primary"), (F.col("o_custkey") % 7).alias("secondary"), (F.col("c_nationkey") + F.col("o_custkey") % 5).cast("double").alias("v"))

    _add("compress_triplets", lambda s, d: _shown(sources.compress_triplets(triple(s, d), 25)[0]), f"WITH t AS ({triplets}), q AS (SELECT p AS i, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s, v) AS x, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY s, v) AS y FROM t GROUP BY 1) SELECT a.i, coalesce(x, '') AS \"index\", coalesce(y, '') AS \"value\" FROM (SELECT unnest(range(25)) AS i) a LEFT JOIN q ON a.i = q.i")
    _add("compress_triplets_pointers", lambda s, d: sources.compress_triplets(triple(s, d), 25)[1], f"WITH t AS ({triplets}) SELECT a.i, (SELECT count(*) FROM t WHERE t.p < a.i) AS pointer FROM (SELECT unnest(range(26)) AS i) a")
    _add("from_triplets_combined", lambda s, d: sources.from_triplets(triple(s, d), 25, 7, combine="sum").entries, f"SELECT p AS r, s AS c, sum(v) AS v FROM ({triplets}) GROUP BY 1, 2")
    _add("from_dense_rows", lambda s, d: E(s, d).cells(), f"WITH {E_SQL} SELECT r, c, v FROM e")

    def flat(s: SparkSession, d: str) -> DataFrame:
        df = _read(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v"))
        return sources.from_flat(df, df.count() // 10, 10).cells()

    _add("from_flat", flat, "SELECT p_partkey // 10 AS r, p_partkey % 10 AS c, CAST(p_size AS DOUBLE) AS v FROM part")

    def slice_(s: SparkSession, d: str) -> DataFrame:
        """Columns 3 to 42 of rows 0 to 39; of fewer suppliers, all columns from 3 on."""
        m = S(s, d)
        start = min(3, m.ncol)
        return unary.arithmetic(m, "add", 2.0).dense_row(start, min(40, m.ncol - start), oracle=ConsecutiveOracle(0, 40)).select("step", "i", F.posexplode("x").alias("k", "v"))

    _add("dense_slice_of_sum", slice_, f"WITH {S_SQL} SELECT r.r AS step, r.r AS i, CAST(c.c AS INTEGER) AS k, coalesce(s.v, 0.0) + 2 AS v FROM (SELECT unnest(range(40)) AS r) r CROSS JOIN (SELECT unnest(range(least(40, (SELECT count(*) FROM supplier) - 3))) AS c) c LEFT JOIN s ON s.r = r.r AND s.c = c.c + 3")


def _more() -> None:
    """Forms of the operations above that those queries leave out: left-hand and by-row vectors, other kinds of storage, oracles, fills."""
    flag = "CASE WHEN {} THEN 1.0 ELSE 0.0 END"
    joined = "string_agg(CAST(CAST({v} AS BIGINT) AS VARCHAR), ',' ORDER BY {o})"
    for op in ("subtract", "divide", "power", "modulo", "integer_divide"):
        value = ARITHMETIC_SQL[op].format(a="w", b="v")
        _add(f"arithmetic_row_vector_left_{op}", lambda s, d, op=op: _cells(unary.arithmetic(C(s, d), op, _nations(s, d), right=False, by_row=True), 9), f"WITH {N_SQL} SELECT r, c, round({_plain(value)}, 9) AS v FROM n")
        value = ARITHMETIC_SQL[op].format(a=MONTHS_SQL, b="v")
        _add(f"arithmetic_column_vector_left_{op}", lambda s, d, op=op: _cells(unary.arithmetic(C(s, d), op, MONTHS, right=False, by_row=False), 9), f"WITH {G_SQL} SELECT r, c, round({_plain(value)}, 9) AS v FROM g")
    for op, sign in COMPARE_SQL.items():
        _add(f"compare_row_vector_{op}", lambda s, d, op=op: _cells(unary.compare(C(s, d), op, _nations(s, d), by_row=True)), f"WITH {N_SQL} SELECT r, c, CAST({flag.format(f'v {sign} w')} AS DOUBLE) AS v FROM n")
        _add(f"substitute_row_vector_{op}", lambda s, d, op=op: _cells(unary.substitute(C(s, d), op, _nations(s, d).select("i", F.col("w").alias("compared"), (F.col("w") * 2).alias("substitute")), by_row=True)), f"WITH {N_SQL} SELECT r, c, {_plain(f'CASE WHEN v {sign} w THEN w * 2 ELSE v END')} AS v FROM n")
    for op, sql in BOOLEAN_SQL.items():
        _add(f"boolean_row_vector_{op}", lambda s, d, op=op: _cells(unary.boolean(C(s, d), op, _nations(s, d), by_row=True)), f"WITH {N_SQL} SELECT r, c, CAST({flag.format(sql.format(a='v', b='w'))} AS DOUBLE) AS v FROM n")
    for test, (sql, inner) in {"isnan": ("isnan(v / 0)", "v / 0"), "isinf": ("isinf(v / 0)", "v / 0")}.items():
        _add(f"substitute_not_{test}", lambda s, d, test=test: _cells(unary.substitute_special(unary.arithmetic(C(s, d), "divide", 0.0), test, 5.0, passes=False)), f"WITH {G_SQL} SELECT r, c, {_plain(f'CASE WHEN NOT {sql} THEN 5.0 ELSE {inner} END')} AS v FROM g")

    def compressed(s: SparkSession, d: str, csr: bool) -> Matrix:
        m = C(s, d)
        flat = sinks.fill_compressed(m, csr)
        ends = sinks.compressed_contents(m, csr).select((F.col("i") + 1).alias("i"), "pointer")
        pointers = s.range(1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("pointer")).union(ends)
        return sources.from_compressed_tables(flat.select("k", F.col("s").alias("index"), "v"), pointers, m.nrow, m.ncol, csr=csr)

    for csr, name in ((True, "csr"), (False, "csc")):
        t, o = ("r", "c") if csr else ("c", "r")
        _add(f"from_compressed_{name}", lambda s, d, csr=csr: compressed(s, d, csr).entries, f"WITH {C_SQL} SELECT r, c, v FROM c")
        _add(f"compressed_{name}_row_block", lambda s, d, csr=csr: _shown(compressed(s, d, csr).sparse_row(2, 6)), f"WITH {C_SQL}, q AS (SELECT r AS i, count(*) AS number, {joined.format(v='c', o='c')} AS \"index\", {joined.format(v='v', o='c')} AS \"value\" FROM c WHERE c >= 2 AND c < 8 GROUP BY 1) SELECT a.i, coalesce(number, 0) AS number, coalesce(\"index\", '') AS \"index\", coalesce(\"value\", '') AS \"value\" FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS i) a LEFT JOIN q ON a.i = q.i")
        _add(f"fill_compressed_{name}", lambda s, d, csr=csr: sinks.fill_compressed(S(s, d), csr), f"WITH {S_SQL} SELECT {t} AS p, {o} AS s, v, row_number() OVER (ORDER BY {t}, {o}) - 1 AS k FROM s")
        _add(
            f"from_fragmented_{name}",
            lambda s, d, csr=csr: sources.from_fragmented(sinks.fragmented_contents(C(s, d), csr), _read(s, d, "customer").count(), 12, row=csr).entries,
            f"WITH {C_SQL} SELECT r, c, v FROM c",
        )

    def by_column(s: SparkSession, d: str) -> Matrix:
        df = _read(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x"))
        return sources.from_rows(df, 64, df.count(), row_major=False)

    _add("from_dense_columns", lambda s, d: by_column(s, d).cells(), f"WITH {E_SQL} SELECT c AS r, r AS c, v FROM e")
    read = lambda m: unary.math_function(unary.arithmetic(m, "multiply", 4.0), "floor")
    for row in (True, False):
        side, t, o = ("row", "r", "c") if row else ("column", "c", "r")
        few = f"SELECT {t} AS i, count(*) AS number, {joined.format(v=o, o=o)} AS \"index\", {joined.format(v='floor(v * 4)', o=o)} AS \"value\" FROM e WHERE {o} >= 3 AND {o} < 13 GROUP BY 1"
        _add(f"sparse_read_of_dense_{side}", lambda s, d, row=row: _shown(read(E(s, d)).sparse_read(row, 3, 10)), f"WITH {E_SQL} {few}")
        _add(f"dense_read_of_dense_{side}", lambda s, d, row=row: _shown(read(E(s, d)).dense(row, [1, 5, 6, 40])), f"WITH {E_SQL} SELECT {t} AS i, {joined.format(v='floor(v * 4)', o=o)} AS x FROM e WHERE {o} IN (1, 5, 6, 40) GROUP BY 1")
        filled = lambda s, d: unary.arithmetic(C(s, d), "add", 1.0)
        _add(f"sparse_read_of_filled_{side}", lambda s, d, row=row, filled=filled: _shown(filled(s, d).sparse_read(row, 1, 7)), f"WITH {G_SQL} SELECT {t} AS i, count(*) AS number, {joined.format(v=o, o=o)} AS \"index\", {joined.format(v='v + 1', o=o)} AS \"value\" FROM g WHERE {o} >= 1 AND {o} < 8 GROUP BY 1")
        steps = "p(step, i) AS (VALUES (0, 4), (1, 1), (2, 4), (3, 0))"
        for kind, args, where in (("block", (1, 7), f"{o} >= 1 AND {o} < 8"), ("index", ([0, 3, 4, 9],), f"{o} IN (0, 3, 4, 9)")):
            _add(
                f"oracle_dense_{side}_{kind}",
                lambda s, d, row=row, args=args: _shown(C(s, d).dense(row, *args, oracle=FixedOracle([4, 1, 4, 0]))),
                f"WITH {G_SQL}, {steps}, q AS (SELECT {t} AS i, {joined.format(v='v', o=o)} AS x FROM g WHERE {where} GROUP BY 1) SELECT CAST(step AS BIGINT) AS step, q.i, x FROM p JOIN q ON p.i = q.i",
            )
            _add(
                f"oracle_sparse_{side}_{kind}",
                lambda s, d, row=row, args=args: _shown(C(s, d).sparse_read(row, *args, oracle=FixedOracle([4, 1, 4, 0]))),
                f"WITH {C_SQL}, {steps}, q AS (SELECT {t} AS i, count(*) AS number, {joined.format(v=o, o=o)} AS \"index\", {joined.format(v='v', o=o)} AS \"value\" FROM c WHERE {where} GROUP BY 1) SELECT CAST(step AS BIGINT) AS step, CAST(p.i AS BIGINT) AS i, coalesce(number, 0) AS number, coalesce(\"index\", '') AS \"index\", coalesce(\"value\", '') AS \"value\" FROM p LEFT JOIN q ON p.i = q.i",
            )
        _add(f"fetch_sparse_{side}", lambda s, d, row=row: _shown(fetch(C(s, d), row, 7, "sparse")), f"WITH {C_SQL} SELECT CAST(7 AS BIGINT) AS i, count(*) AS number, coalesce({joined.format(v=o, o=o)}, '') AS \"index\", coalesce({joined.format(v='v', o=o)}, '') AS \"value\" FROM c WHERE {t} = 7")
        _add(f"bind_read_{side}", lambda s, d, row=row: _shown(reshape.bind([C(s, d), C2(s, d)], False).dense(row, 2, 9)), f"WITH {G2_SQL}, b AS (SELECT r, c, a AS v FROM g2 UNION ALL SELECT r, c + 12, b FROM g2) SELECT {t} AS i, {joined.format(v='v', o=o)} AS x FROM b WHERE {o} >= 2 AND {o} < 11 GROUP BY 1")
        _add(f"subset_perpendicular_{side}", lambda s, d, row=row: _shown(reshape.subset(C(s, d), [5, 2, 5, 11], not row).dense(row)), f"WITH {G_SQL}, p(n, o) AS (VALUES (0, 5), (1, 2), (2, 5), (3, 11)) SELECT {t} AS i, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY n) AS x FROM g JOIN p ON g.{o} = p.o GROUP BY 1")
    for name, listed in {"any": [5, 2, 5, 11, 0], "sorted": [0, 2, 2, 7], "unique": [9, 3, 4], "sorted_unique": [1, 4, 10]}.items():
        pairs = ", ".join(f"({k}, {x})" for k, x in enumerate(listed))
        _add(f"subset_rows_{name}", lambda s, d, listed=listed: _cells(reshape.subset(C(s, d), listed, True)), f"WITH {G_SQL}, p(n, o) AS (VALUES {pairs}) SELECT CAST(n AS BIGINT) AS r, c, v FROM g JOIN p ON g.r = p.o")
    _add("oracle_by_table", lambda s, d: _shown(C(s, d).dense_row(oracle=_read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("step"), (F.col("n_nationkey") % 7).cast("long").alias("index")))), f"WITH {G_SQL}, q AS (SELECT r AS i, {joined.format(v='v', o='c')} AS x FROM g GROUP BY 1) SELECT CAST(n_nationkey AS BIGINT) AS step, q.i, x FROM nation JOIN q ON q.i = n_nationkey % 7")
    _add("custom_matrix", lambda s, d: sources.from_custom(lambda s: _read(s, d, "nation").select(F.col("n_nationkey").alias("r"), F.col("n_regionkey").alias("c"), F.col("n_nationkey").cast("double").alias("v")), s, 25, 5).entries, "SELECT CAST(n_nationkey AS BIGINT) AS r, CAST(n_regionkey AS BIGINT) AS c, CAST(n_nationkey AS DOUBLE) AS v FROM nation")
    _add("cast_index", lambda s, d: reshape.cast(S(s, d), "double", index="int").entries, f"WITH {S_SQL} SELECT r, c, CAST(v AS DOUBLE) AS v FROM s")
    _add("transpose_buffer_strided", lambda s, d: reshape.transpose_buffer(_read(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v")), 10, 7, 11, 13), "SELECT (p_partkey % 11) * 13 + p_partkey // 11 AS k, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_partkey // 11 < 10 AND p_partkey % 11 < 7")
    _add("legacy_triplets_csc", lambda s, d: sources.from_triplets(_read(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("primary"), F.col("n_nationkey").cast("long").alias("secondary"), F.lit(1.0).alias("v")), 25, 5, csr=False).entries, "SELECT CAST(n_nationkey AS BIGINT) AS r, CAST(n_regionkey AS BIGINT) AS c, CAST(1.0 AS DOUBLE) AS v FROM nation")


ROWS_OF_A_BLOCK = 1000
BEYOND = 9007199254740993  # 2 ** 53 + 1, which no double is


def Long(spark: SparkSession, sf: str) -> Matrix:
    """Customer by month: order counts and BEYOND, as whole numbers."""
    df = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("r"), (F.month("o_orderdate") - 1).alias("c")).agg((F.count("*") + BEYOND).alias("v"))
    return sources.from_coo(df, _read(spark, sf, "customer").count(), 12, dtype="bigint")


LONG_SQL = f"{CELLS_SQL}, l AS (SELECT k.r, k.c, coalesce(o.v, 0) AS v FROM k LEFT JOIN (SELECT o_custkey AS r, month(o_orderdate) - 1 AS c, count(*) + {BEYOND} AS v FROM orders GROUP BY 1, 2) o ON o.r = k.r AND o.c = k.c)"
WHOLE_SQL = {
    "add": "{a} + {b}",
    "subtract": "{a} - {b}",
    "multiply": "{a} * {b}",
    "modulo": "(({a} % {b}) + {b}) % {b}",
    "integer_divide": "{a} // {b} - CASE WHEN {a} % {b} <> 0 AND ({a} < 0) <> ({b} < 0) THEN 1 ELSE 0 END",
}


def _stored(spark: SparkSession, make: Callable[[], Matrix], tile: tuple[int, int]) -> tuple[str, Matrix]:
    """A matrix written to a new folder and opened again."""
    path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    sources.write_tiles(make(), path, tile)
    return path, sources.open_tiles(spark, path)


def _layout() -> None:
    """Blocks given to user functions, stored tiles, selections that reach a scan, exact whole numbers."""
    joined = "string_agg(CAST(CAST({v} AS BIGINT) AS VARCHAR), ',' ORDER BY {o})"

    def maxima(place: blocks.Place, block: blocks.Csr) -> dict[str, object]:
        top = np.where(np.bincount(block.indices, minlength=place.width) < place.length, 0.0, -np.inf)
        np.maximum.at(top, block.indices, block.values)
        return {"start": np.full(place.width, place.start), "c": place.first + np.arange(place.width), "top": top}

    grid = f"b AS (SELECT b, c FROM (SELECT unnest(range(((SELECT count(*) FROM orders) + {ROWS_OF_A_BLOCK - 1}) // {ROWS_OF_A_BLOCK})) AS b) CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM supplier))) AS c))"
    _add("map_blocks_column_maxima", lambda s, d: blocks.map_blocks(S(s, d), maxima, "start long, c long, top double", length=ROWS_OF_A_BLOCK, sparse=True), f"WITH {S_SQL}, {grid} SELECT b.b * {ROWS_OF_A_BLOCK} AS start, b.c, CAST(greatest(coalesce(max(v), 0), 0) AS DOUBLE) AS top FROM b LEFT JOIN s ON s.r // {ROWS_OF_A_BLOCK} = b.b AND s.c = b.c GROUP BY 1, 2")

    def totals(place: blocks.Place, block: np.ndarray) -> dict[str, object]:
        return {"start": [place.start], "first": [place.first], "cells": [block.size], "total": [float(block.sum())], "top": [float(block.max())]}

    for by_row, side, p, o in ((True, "row", "r", "c"), (False, "column", "c", "r")):
        length, width = (37, 5) if by_row else (5, 37)
        _add(
            f"map_blocks_filled_{side}",
            lambda s, d, by_row=by_row, length=length, width=width: blocks.map_blocks(unary.arithmetic(C(s, d), "add", _nations(s, d), by_row=True), totals, "start long, first long, cells long, total double, top double", by_row=by_row, length=length, width=width),
            f"WITH {N_SQL} SELECT {p} // {length} * {length} AS start, {o} // {width} * {width} AS first, count(*) AS cells, sum(v + w) AS total, max(v + w) AS top FROM n GROUP BY 1, 2",
        )
    _add("store_round_trip", lambda s, d: _stored(s, lambda: S(s, d), (4096, 64))[1].entries, f"WITH {S_SQL} SELECT r, c, v FROM s")
    for row in (True, False):
        t, o, side = ("r", "c", "row") if row else ("c", "r", "column")
        first, n = (2, 6) if row else (20, 60)
        _add(f"store_read_{side}_block", lambda s, d, row=row, first=first, n=n: _shown(_stored(s, lambda: unary.arithmetic(C(s, d), "add", _nations(s, d), by_row=True), (64, 4))[1].dense(row, first, n)), f"WITH {N_SQL} SELECT {t} AS i, {joined.format(v='v + w', o=o)} AS x FROM n WHERE {o} >= {first} AND {o} < {first + n} GROUP BY 1")
    _add("store_between", lambda s, d: sources.entries_between(s, _stored(s, lambda: S(s, d), (512, 16))[0], 60.0, 90.0), f"WITH {S_SQL} SELECT r, c, v FROM s WHERE v BETWEEN 60 AND 90")
    _add("store_stats", lambda s, d: sources.tile_stats(s, _stored(s, lambda: S(s, d), (512, 16))[0]), f"WITH {S_SQL} SELECT r // 512 AS tr, c // 16 AS tc, count(*) AS n, min(v) AS least, max(v) AS most, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS zeros FROM s GROUP BY 1, 2")

    def listed(s: SparkSession, d: str) -> DataFrame:
        m = S(s, d)
        return _shown(m.sparse_row(at=range(0, m.nrow, max(1, m.nrow // 5000))))

    _add("listed_rows", listed, f"WITH {S_SQL}, e AS (SELECT greatest(1, (SELECT count(*) FROM orders) // 5000) AS n), q AS (SELECT r AS i, count(*) AS number, {joined.format(v='c', o='c')} AS \"index\", {joined.format(v='v', o='c')} AS \"value\" FROM s GROUP BY 1) SELECT a.i, coalesce(number, 0) AS number, coalesce(\"index\", '') AS \"index\", coalesce(\"value\", '') AS \"value\" FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders), (SELECT n FROM e))) AS i) a LEFT JOIN q ON a.i = q.i")

    def middle(s: SparkSession, d: str) -> DataFrame:
        m = S(s, d)
        return _shown(reshape.bind([m, unary.arithmetic(m, "multiply", 2.0), m], True).sparse_row(at=(2 * m.nrow - 5, 10)))

    _add("bind_rows_block", middle, f"WITH {S_SQL}, n AS (SELECT count(*) AS n FROM orders), b AS (SELECT r + n AS r, c, v * 2 AS v FROM s, n UNION ALL SELECT r + 2 * n, c, v FROM s, n), q AS (SELECT r AS i, count(*) AS number, {joined.format(v='c', o='c')} AS \"index\", {joined.format(v='v', o='c')} AS \"value\" FROM b GROUP BY 1) SELECT a.i, coalesce(number, 0) AS number, coalesce(\"index\", '') AS \"index\", coalesce(\"value\", '') AS \"value\" FROM (SELECT unnest(range(2 * n - 5, 2 * n + 5)) AS i FROM n) a LEFT JOIN q ON a.i = q.i")
    for op, sql in WHOLE_SQL.items():
        _add(f"exact_long_scalar_{op}", lambda s, d, op=op: unary.arithmetic(Long(s, d), op, 7).cells(), f"WITH {LONG_SQL} SELECT r, c, CAST({sql.format(a='v', b='7')} AS BIGINT) AS v FROM l")
        _add(f"exact_int_row_vector_{op}", lambda s, d, op=op: unary.arithmetic(reshape.cast(C(s, d), "int"), op, _nations(s, d).select("i", F.when(F.col("w") == 0, 9).otherwise(F.col("w")).cast("int").alias("w")), by_row=True).cells(), f"WITH {N_SQL}, x AS (SELECT r, c, CAST(v AS INTEGER) AS v, CAST(CASE WHEN w = 0 THEN 9 ELSE w END AS INTEGER) AS w FROM n) SELECT r, c, CAST({sql.format(a='v', b='w')} AS INTEGER) AS v FROM x")
        if op in ("add", "subtract", "multiply"):
            _add(f"exact_long_binary_{op}", lambda s, d, op=op: binary.arithmetic(Long(s, d), reshape.cast(C(s, d), "int"), op).cells(), f"WITH {G_SQL}, {LONG_SQL[len(CELLS_SQL) + 2 :]} SELECT l.r, l.c, CAST({sql.format(a='l.v', b='CAST(g.v AS BIGINT)')} AS BIGINT) AS v FROM l JOIN g ON g.r = l.r AND g.c = l.c")


def _custom() -> None:
    """Functions of NumPy arrays, compressed storage in two passes, triplets of any length, a source that is told what is wanted."""
    joined = "string_agg(CAST(CAST({v} AS BIGINT) AS VARCHAR), ',' ORDER BY {o})"

    def scaled(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return v * (c % 7 + 1)

    def lifted(v: np.ndarray, r: np.ndarray) -> np.ndarray:
        return v * 2 + r % 5

    def apart(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(a, b) * 3 - c

    _add("custom_arrays_sparse", lambda s, d: unary.custom(S(s, d), unary.Helper(of_cells(scaled, column=True), keeps_zero=True)).entries, f"WITH {S_SQL} SELECT r, c, CAST(v * (c % 7 + 1) AS DOUBLE) AS v FROM s")
    _add("custom_arrays_by_row", lambda s, d: _cells(unary.custom(C(s, d), unary.Helper(of_cells(lifted, row=True), depends_on_row=True))), f"WITH {G_SQL} SELECT r, c, CAST(v * 2 + r % 5 AS DOUBLE) AS v FROM g")
    _add("custom_arrays_row_sums", lambda s, d: sinks.sums(unary.custom(C(s, d), unary.Helper(of_cells(lifted, row=True), depends_on_row=True))), f"WITH {G_SQL} SELECT r AS i, CAST(sum(v * 2 + r % 5) AS DOUBLE) AS total FROM g GROUP BY 1")
    _add("custom_arrays_binary", lambda s, d: _cells(binary.combine(C(s, d), C2(s, d), binary.BinaryHelper(of_pairs(apart, column=True)))), f"WITH {G2_SQL} SELECT r, c, CAST(greatest(a, b) * 3 - c AS DOUBLE) AS v FROM g2")

    def striped(s: SparkSession, d: str) -> Matrix:
        """Entries where row + column is divisible by three, with their product and one; as many rows as customers."""

        def read(rows: tuple[int, int], columns: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r, c = (x.ravel() for x in np.meshgrid(rows[0] + np.arange(rows[1]), columns[0] + np.arange(columns[1]), indexing="ij"))
            own = (r + c) % 3 == 0
            return r[own], c[own], (r * c + 1.0)[own]

        return sources.from_blocks(s, read, _read(s, d, "customer").count(), 12)

    stripes = "x AS (SELECT r, c, CAST(r * c + 1 AS DOUBLE) AS v FROM k WHERE (r + c) % 3 = 0)"
    _add("custom_source", lambda s, d: striped(s, d).entries, f"WITH {CELLS_SQL}, {stripes} SELECT r, c, v FROM x")
    _add("custom_source_block", lambda s, d: _shown(striped(s, d).sparse_row(3, 5, at=(10, 90))), f"WITH {CELLS_SQL}, {stripes}, q AS (SELECT r AS i, count(*) AS number, {joined.format(v='c', o='c')} AS \"index\", {joined.format(v='v', o='c')} AS \"value\" FROM x WHERE c >= 3 AND c < 8 GROUP BY 1) SELECT a.i, coalesce(number, 0) AS number, coalesce(\"index\", '') AS \"index\", coalesce(\"value\", '') AS \"value\" FROM (SELECT unnest(range(10, 100)) AS i) a LEFT JOIN q ON a.i = q.i")

    def written(s: SparkSession, d: str, row: bool) -> str:
        path = f"{shared_folder(s)}/compressed-{uuid.uuid4().hex}"
        sources.write_compressed(S(s, d), path, row)
        return path

    for row, name in ((True, "csr"), (False, "csc")):
        t, o = ("r", "c") if row else ("c", "r")
        _add(f"stored_{name}_entries", lambda s, d, row=row: sources.open_compressed(s, written(s, d, row)).entries, f"WITH {S_SQL} SELECT r, c, v FROM s")
        _add(f"stored_{name}_contents", lambda s, d, row=row: sources.stored_contents(s, written(s, d, row))[0], f"WITH {S_SQL} SELECT row_number() OVER (ORDER BY {t}, {o}) - 1 AS k, {o} AS \"index\", v FROM s")
    _add("stored_csr_pointers", lambda s, d: sources.stored_contents(s, written(s, d, True))[1], f"WITH {S_SQL}, n AS (SELECT r, count(*) AS n FROM s GROUP BY 1) SELECT a.i, CAST(coalesce(sum(n.n) OVER (ORDER BY a.i), 0) AS BIGINT) AS pointer FROM (SELECT unnest(range((SELECT count(*) FROM orders) + 1)) AS i) a LEFT JOIN n ON n.r = a.i - 1")

    def packed(s: SparkSession, d: str, make: Callable[[SparkSession, str], Matrix]) -> str:
        path = f"{shared_folder(s)}/packed-{uuid.uuid4().hex}"
        sources.write_packed(make(s, d), path, (512, 256))
        return path

    _add("packed_whole_numbers", lambda s, d: sources.open_packed(s, packed(s, d, S)).entries, f"WITH {S_SQL} SELECT r, c, v FROM s")
    _add("packed_floats", lambda s, d: sources.open_packed(s, packed(s, d, E)).cells(), f"WITH {E_SQL} SELECT r, c, v FROM e")
    _add("packed_long_numbers", lambda s, d: sources.open_packed(s, packed(s, d, Long)).cells(), f"WITH {LONG_SQL} SELECT r, c, CAST(v AS BIGINT) AS v FROM l")
    for name, make, cte, table, kinds in (
        ("whole_numbers", S, S_SQL, "s", "CASE WHEN max(v) <= 127 THEN 'int8' ELSE 'int16' END"),
        ("floats", E, E_SQL, "e", "'float32'"),
    ):
        size = {"s": "CASE WHEN max(v) <= 127 THEN 1 ELSE 2 END", "e": "4"}[table]
        _add(f"packed_{name}_bytes", lambda s, d, make=make: sources.packed_tiles(s, packed(s, d, make)).select("tr", "tc", "n", "value_kind", F.octet_length("values").cast("long").alias("value_bytes")), f"WITH {cte} SELECT r // 512 AS tr, c // 256 AS tc, count(*) AS n, {kinds} AS value_kind, CAST(count(*) * {size} AS BIGINT) AS value_bytes FROM {table} GROUP BY 1, 2")
    triplets = "SELECT CAST(c_nationkey AS BIGINT) AS p, o_custkey % 7 AS s, CAST(c_nationkey + o_custkey % 5 AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey"

    def triple(s: SparkSession, d: str) -> DataFrame:
        met = _read(s, d, "orders").join(_read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        return met.select(F.col("c_nationkey").cast("long").alias("primary"), (F.col("o_custkey") % 7).alias("secondary"), (F.col("c_nationkey") + F.col("o_custkey") % 5).cast("double").alias("v"))

    _add("sorted_triplets", lambda s, d: sources.sorted_triplets(triple(s, d), 25)[0], f"SELECT row_number() OVER (ORDER BY p, s, v) - 1 AS k, p AS \"primary\", s AS \"index\", v FROM ({triplets})")


for _group in (_arithmetic, _comparisons, _functions, _shapes, _reads, _more, _layout, _custom):
    _group()


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The first five columns of the slice: a handful of rows."""
    return QUERIES["dense_slice_of_sum"](spark, sf).where("k < 5")
