import os
import subprocess
import sys

import __spark_entry__ as entry
import pytest
from gridloom import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_matrix_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL) and set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["step", "i", "k", "v"] and df.count() == 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["arithmetic_scalar_left_divide", "binary_arithmetic_modulo", "sparse_column_block", "compressed_row", "oracle_dense_row"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = catalog.QUERIES[name](spark, SF), db.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("suppliers", [2, 10, 42, 43, 60])
def test_dense_slice_has_all_of_its_columns(spark, tmp_path, suppliers):
    import duckdb

    items = [(k * 11 % 45, (k * 7 + k // 45) % suppliers, float(1 + k % 9)) for k in range(900)]
    tables = {"orders": ([(k,) for k in range(45)], "o_orderkey long"), "supplier": ([(k,) for k in range(suppliers)], "s_suppkey long"), "lineitem": (items, "l_orderkey long, l_suppkey long, l_quantity double")}
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    totals = {}
    for r, c, v in items:
        totals[r, c] = totals.get((r, c), 0.0) + v
    want = [(r, r, k, totals.get((r, k + 3), 0.0) + 2) for r in range(40) for k in range(min(40, suppliers - 3))]
    found = catalog.QUERIES["dense_slice_of_sum"](spark, str(tmp_path)).select("step", "i", "k", "v")
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(db.sql(f"SELECT step, i, k, v FROM ({catalog.SQL['dense_slice_of_sum']})").fetchall()) == want


def test_works_without_the_llm_folders(tmp_path):
    kept = tmp_path / "repo"
    kept.mkdir()
    for name in ("gridloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), kept], check=True)
    subprocess.run(["rm", "-rf", kept / "gridloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=kept, env={**os.environ, "PYTHONPATH": str(kept)}, check=True)
