import random

import numpy as np
import pyarrow as pa
from gridloom.llm import substring_dedup as D


def brute(rows):
    least, out = {}, []
    key = lambda d: 2**62 if d is None else d
    split = lambda t: (t or "").encode().split()
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            least[g] = min(key(d), least.get(g, key(d)))
    for d, t in rows:
        w = split(t)
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < key(d) for j in range(i, i + 13)}
        out.append((key(d), len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


def data(seed, copies=6):
    rng = random.Random(seed)
    say = lambda n: "".join(f"w{rng.randrange(40)}é{rng.choice([' ', '  ', chr(10), chr(9)])}" for _ in range(n))
    passage, line = say(30), "all rights reserved by the owner of this page and site "
    rows = [(7, None), (8, ""), (9, " \n "), (None, passage), (None, passage), (3, "a " * 400), (2, "a " * 100), (3, "a " * 400)]
    for k in range(40):
        t = say(rng.randrange(0, 50)) + rng.choice([passage, "", line, line + passage]) + say(rng.randrange(30))
        rows.append((100 - k, t))
    return rows + [(500 + k, rows[12][1]) for k in range(copies)] + [(101, "x" * 5000 + " " + passage)]


def test_matches_brute_force(spark, monkeypatch):
    for seed, share in ((1, 1 / 4), (2, 1e-9), (3, 1e9)):
        monkeypatch.setattr(D, "HOT", share)
        rows = data(seed, 40)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as bin", "3 as n_words")
        got = sorted((2**62 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in D.dedup(spark, df).collect())
        assert got == brute(rows)
    assert D.dedup(spark, df.limit(0)).count() == 0


def test_common_minimisers_are_dealt_apart(spark):
    rows = data(3, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert D._common(df, 4, 10**6).any() and len(D._common(df.limit(0), 4, 0)) == 0
    got = sorted((2**62 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in D.dedup(spark, df).collect())
    assert got == brute(rows)


def test_a_window_in_every_block_goes_to_no_bin(spark):
    line = " ".join(f"line{i}" for i in range(13)) + " "
    rows = [(k, line + " ".join(f"own{k}x{i}" for i in range(20))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = D._common(df, 8, 200 * 200)
    assert hot.any()
    data = D._deal(pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in rows]), "text": [t for _, t in rows]}), 1)
    assert line not in " ".join(D._spread_out(b, "<u4", "u1", "<i8", "<i8")[4].tobytes().decode() for b in D._send(pa.table(data), 8, hot).column("pieces").to_pylist())
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in D.dedup(spark, df).collect())
    assert got == brute(rows)


def test_the_greatest_id_is_not_a_null_one(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(2**63 - 1, text), (None, text), (5, text)]
    got = {r.doc_id: r.n_removed for r in D.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2**63 - 1: 20, None: 20, 5: 0}


def test_equal_hashes_are_told_apart():
    text = np.frombuffer(b"".join(f"{c} ".encode() * 13 for c in "abab"), np.uint8)
    off = np.arange(5) * 26
    got = D.first_ids(text, off, np.ones(4, np.int64), np.array([4, 3, 2, 1]), lambda: np.zeros(52, np.uint64))
    assert got.tolist() == [2, 1, 2, 1]
