import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import tables, textbuf
from pyspark.sql import functions as F


def test_slices_respect_bytes_and_rows():
    off = np.array([0, 5, 5, 50, 51, 52])
    assert list(textbuf.slices(off, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(textbuf.slices(off, 100, rows=2)) == [(0, 2), (2, 4), (4, 5)]
    assert list(textbuf.slices(np.zeros(1, np.int64))) == []


def test_hashes_tell_long_words_apart():
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgh" * 9 + b"x", b"abcdefgh" * 9 + b"y", b"abcdefgh" * 10]
    data = np.frombuffer(b"".join(words * 2), np.uint8)
    ends = np.cumsum([len(w) for w in words * 2])
    h = textbuf.hashes(data, np.append(0, ends[:-1]), ends)
    assert (h[:7] == h[7:]).all() and len(set(h.tolist())) == 7


def test_gather_in_chunks(monkeypatch):
    monkeypatch.setattr(textbuf, "GATHERED", 4)
    data = np.frombuffer(b"0123456789", np.uint8)
    got, off = textbuf.gather(data, np.array([1, 0, 5, 9]), np.array([3, 9, 5, 10]))
    assert got.tobytes() == b"120123456789"[:2] + b"012345678" + b"9" and off.tolist() == [0, 2, 11, 11, 12]


def test_append_slices_batches_and_replaces_columns(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * (i % 50) if i % 7 else None) for i in range(500)], "doc_id long, text string").selectExpr("*", "'old' as n")
    made = tables.append(df, "n long", lambda b: [pa.array([b.num_rows] * b.num_rows, pa.int64())])
    rows = made.collect()
    assert len(rows) == 500 and made.columns == ["doc_id", "text", "n"]
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 9, "d"]})
    assert [b.num_rows for b in tables.parts(batch, 4)] == [2, 1, 1]


def test_bounded_samples(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 20, "few").otherwise("many").alias("k"))
    got = {r["k"]: r["count"] for r in tables.bounded(df, "k", "id", 100).groupBy("k").count().collect()}
    assert got["few"] == 20 and 50 < got["many"] < 160
    assert tables.bounded(df.limit(0), "k", "id", 100).count() == 0


def test_bounded_samples_of_many_classes(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id", "id % 500 as k")
    one = sorted(r.id for r in tables.bounded(df, "k", "id", 4).collect())
    assert 1400 < len(one) < 2600
    monkeypatch.setattr(tables, "SENT_KEYS", 10)
    assert sorted(r.id for r in tables.bounded(df, "k", "id", 4).collect()) == one
    monkeypatch.setattr(tables, "FEW_CLASSES", 1000)
    assert sorted(r.id for r in tables.bounded(df, "k", "id", 4).collect()) == one


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Session())


def test_alike_rows_are_dealt_apart_and_alike_again():
    import numpy as np
    from gridloom.llm import tables

    keys = np.array([7] * 20_000 + list(range(100, 400)), np.uint64)
    one = tables.shares(keys, tables.Repeats()) % np.uint64(64)
    assert len(np.unique(one[:20_000])) == 64
    order = np.random.default_rng(1).permutation(len(keys))
    repeats = tables.Repeats()
    two = np.concatenate([tables.shares(keys[p], repeats) % np.uint64(64) for p in np.array_split(order, 9)])
    assert sorted(zip(keys.tolist(), one.tolist(), strict=True)) == sorted(zip(keys[order].tolist(), two.tolist(), strict=True))


def test_null_ids_of_one_length_fill_many_blocks():
    import pyarrow as pa
    from gridloom.llm import substring_dedup as D

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None] * 20_000, pa.int64()), "text": [f"text {k:06d}" for k in range(20_000)]})
    assert D._deal(batch, 64).num_rows == 64
