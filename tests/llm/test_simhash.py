import random

import xxhash
from gridloom.llm import simhash as S


def brute(rows):
    def fp(t):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        if not words:
            return 0
        sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = ["alpha", "Beta", "gamma", "é", "x1", "the", "of"]
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (None, "lost id"), (10, "a b c d"), (10, "a b c d")]
    for i in range(60):
        base = [rng.choice(vocab) + str(rng.randrange(99)) for _ in range(rng.randrange(3, 400))]
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = "changed"
            rows.append((1000 + len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, f"{r.simhash % 2**64:016x}", r.component_id) for r in S.groups(df).collect())
    assert got == brute(rows)
    assert S.groups(df.limit(0)).count() == 0


def test_large_buckets_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    found = {r.node: r.root for r in S.components(S.links(S.buckets(df, most=20))).collect()}
    comp = {x: x for x in fps}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                comp[find(x)] = find(y)
    groups = {}
    for x in fps:
        s = x - 2**64 if x >= 2**63 else x
        groups.setdefault(find(x), set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(4, text, "x"), (2, text, "y"), (2, text, "y"), (9, text + " end", "z"), (11, "another text of few words here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted(r.doc_id for r in S.keep_one(spark, df, "").collect()) == [2, 11]


def test_stage_keeps_unrelated_rows_of_null_or_equal_ids(spark):
    text = [" ".join(f"{w}{i}" for i in range(200)) for w in ("one", "two", "three", "four", "five")]
    copy = text[4] + " end"
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (3, text[2]), (5, text[3]), (5, text[2]), (None, None), (None, ""), (7, copy), (7, text[4]), (7, text[4])]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, root int")
    out = S.keep_one(spark, df.repartition(3), "")
    assert out.columns == df.columns
    want = [(None, text[0], 0), (None, text[1], 1), (3, text[2], 4), (5, text[3], 5), (None, "", 8), (7, min(copy, text[4]), 10)]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == want
    assert S.keep_one(spark, df.limit(0), "").count() == 0


def test_attach_is_an_inner_join_by_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(S.tables, "HEAVY", 10)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 200) as k", "id as x")
    found = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as y").where("k != 5")
    got = S.attach(rows, found, "k", 3000)
    assert got.columns == ["k", "x", "y"] and got.where("y != 2 * k").count() == 0
    assert got.count() == rows.where("k != 5").count() and got.select("x").distinct().count() == got.count()


def test_one_giant_component(spark):
    n = 3000
    edges = [(0, i) for i in range(1, n)] + [(n + i, n + i + 1) for i in range(200)] + [(n + 100, 17), (10**6, 10**6)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n + 201), 0)
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_third_of_all_rows_is_one_text(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(3 * i, None if i % 2 else "", i) for i in range(200)] + [(3 * i + 1, say(0) + " more" * (i % 3), i) for i in range(200)] + [(3 * i + 2, say(1 + i), i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int").selectExpr("*", "doc_id % 5 as rest", "'k' as row_key", "1 as simhash").repartition(5)
    found = S.groups(df)
    kept = S.keep_one(spark, df, "")
    assert found.count() == len(rows) and kept.columns == df.columns
    assert kept.count() == found.select("component_id").distinct().count()
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found.collect()}
