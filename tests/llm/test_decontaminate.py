import random
import re

import numpy as np
from gridloom.llm import decontaminate as D
from gridloom.llm.fm_index import FmIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k, it in items:
            v = words(it)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found |= {str(k)} if k is not None else set()
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


def data(seed):
    rng = random.Random(seed)
    vocab = ["ab", "cd", "éf", "G1", "averylongwordindeed", "averylongwordindeee", "x"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "  "]) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 12, 25]))) for k in range(8)] + [(3, say(14)), (None, say(15)), (20, None), (21, " .")]
    docs = []
    for k in range(40):
        t = say(rng.randrange(0, 60)) + "other words " * rng.randrange(3)
        if k % 3 == 0:
            t += items[rng.randrange(8)][1] + say(4)
        docs.append((k // 2, t))
    return docs + [(90, None), (91, ""), (None, items[2][1]), (92, "none at all here")], items


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 3), (500, 3), (2000, 9), (300, 2)):
        text = rng.integers(1, sigma, n)
        whole = np.append(text, 0)
        assert suffix_array(whole, sigma).tolist() == sorted(range(n + 1), key=lambda i: whole[i:].tolist())
        index = FmIndex(text, sigma)
        patterns = rng.integers(1, sigma, (50, 4))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 3) if (text[i : i + 4] == p).all()]


def test_matches_brute_force_and_blocks(spark, monkeypatch):
    for seed, block in ((1, 1 << 20), (2, 40)):
        monkeypatch.setattr(D, "SHARD_BYTES", 400)
        docs, items = data(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as n_words", "1 as item_id")
        bench = spark.createDataFrame(items, "item_id long, text string")
        monkeypatch.setattr(D, "SENT_BYTES", block)
        monkeypatch.setattr(D, "BLOCK_BYTES", 60)
        got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_hit, ",".join(r.hit_items)) for r in D.scan(spark, df, bench).collect())
        assert got == [(-1 if d is None else d, *x) for d, *x in sorted(brute([(-1 if d is None else d, t) for d, t in docs], items))]
        assert D.scan(spark, df.limit(0), bench).count() == 0
        assert all(r.n_hit == 0 for r in D.scan(spark, df, bench.limit(0)).collect())


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, f"Keep é. {item.upper()}! And this."), (2, "clean  text,\n kept"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.cleaned for r in D.remove(D.scan(spark, df, spark.createDataFrame([(1, item)], "item_id long, text string"))).collect()}
    assert out == {1: "Keep é. ! And this.", 2: "clean  text,\n kept", 3: None}


def test_plan_does_not_grow_with_the_benchmark(spark, monkeypatch):
    docs, items = data(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)
    for sent in (1 << 20, 40):
        monkeypatch.setattr(D, "SENT_BYTES", sent)
        assert D.scan(spark, df, bench)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_stage_passes_other_columns_through(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, f"a {passage} b", "x", 5, 99), (None, None, "y", 6, None), (1, "", "z", 7, 0)], "doc_id long, text string, n_words string, cleaned int, n_chars int")
    out = D.cut_benchmark(spark, df, str(tmp_path))
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect()), key=lambda r: r[3]) == [(1, "a  b", "x", 5, 4), (None, None, "y", 6, None), (1, "", "z", 7, 0)]
    assert D.cut_benchmark(spark, df.limit(0), str(tmp_path)).count() == 0
