import numpy as np
from gridloom.llm import metric_tree as M


def brute(rows, queries, k):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i in queries:
            asked.setdefault(i, v)
    out = []
    for i, q in sorted(asked.items()):
        scores = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), j) for j, v in ok if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return out


def test_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.05).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 1.0]) for i in range(200)]
    rows += [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (2400, []), (2500, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as shard")
    monkeypatch.setattr(M, "PAGE", 8)
    monkeypatch.setattr(M, "FAN", 4)
    q = {i for i, _ in rows if i is not None and i % 100 == 0}
    for size in (1 << 20, 100):
        monkeypatch.setattr(M, "QUERY_BYTES", size)
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in M.search(spark, df, df.where("vec_id % 100 = 0")).collect())
        assert got == brute(rows, q, 10)
    assert M.search(spark, df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 4")
    assert M.search(spark, few, few.where("vec_id = 0")).count() == 3


def test_bounds_spare_distances(monkeypatch):
    monkeypatch.setattr(M, "PAGE", 8)
    monkeypatch.setattr(M, "FAN", 4)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(-50, 50, (400, 8)) + c for c in rng.integers(-2000, 2000, (10, 8))])
    tree = M.MTree(np.arange(len(v)), v)
    q = v[3]
    assert sorted(tree.top(3, q, 10), reverse=True) == sorted(((int(x @ q), i) for i, x in enumerate(v) if i != 3), key=lambda r: (-r[0], r[1]))[:10]


def test_trees_route_at_production_sizes(spark, monkeypatch):
    built = []
    monkeypatch.setattr(M, "shard_count", lambda rows, partitions, f=M.shard_count: built.append((rows, f(rows, partitions))) or built[-1][1])
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(100, 8)) * 0.02 + c for c in rng.normal(size=(21, 8))])
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in M.search(spark, df, df.where("vec_id % 300 = 0")).collect())
    assert got == brute(rows, {i for i, _ in rows if i % 300 == 0}, 10)
    assert built == [(2100, 1)] and [M.shard_count(n, 12) for n in (0, 500, 2000, 10256, 51282, 10**6)] == [1, 1, 1, 5, 12, 123]

    class Counting:
        seen = 0

        def __init__(self, x):
            self.x = x

        def __len__(self):
            return len(self.x)

        def __getitem__(self, rows):
            Counting.seen += len(rows)
            return self.x[rows]

    tree = M.MTree(np.arange(len(v)), np.floor(1024 * v).astype(int))
    assert tree.root.children
    tree.vectors = Counting(tree.vectors)
    for i in range(0, len(v), 300):
        tree.top(i, np.floor(1024 * v[i]).astype(int), 10)
    assert Counting.seen < len(v) * 7 / 2


def clustered(clusters, each, width, seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    v = np.concatenate([rng.normal(size=(each, width)) * 0.05 + c for c in centres])
    return rng.permutation(v / np.linalg.norm(v, axis=1, keepdims=True))


def walk(v, cells, asked, k=10):
    """The k best of each query, and the share of all scores that were worked out, routing distances counted."""
    points = M.routes(v[:: max(1, len(v) // (M.SAMPLED * cells))].copy(), cells)
    own = M.nearest(v, points)
    trees = {c: M.MTree(np.flatnonzero(own == c), v[own == c]) for c in np.unique(own)}
    out, asked_cells = {}, 0
    for i in asked:
        home = int((v[i] @ points.T).argmax())
        got = trees[home].top(i, v[i], k) if home in trees else []
        floor = sorted(got, reverse=True)[k - 1][0] if len(got) >= k else -np.inf
        asked_cells += len(points)
        for c, t in trees.items():
            if c != home and len(t.near(v[i : i + 1], np.array([floor]))):
                got += t.top(i, v[i], k, floor)
        out[i] = sorted(got, key=lambda r: (-r[0], r[1]))[:k]
    return out, (asked_cells + sum(t.computed for t in trees.values())) / (len(asked) * len(v))


def test_cells_and_trees_spare_most_scores_of_clustered_vectors():
    v = np.floor(1024 * clustered(100, 200, 64))
    asked = range(0, len(v), 1000)
    got, share = walk(v, M.shard_count(len(v), 12), asked)
    for i in asked:
        assert got[i] == sorted(((int(s), j) for j, s in enumerate(v @ v[i]) if j != i), key=lambda r: (-r[0], r[1]))[:10]
    assert share < 0.25, share


def test_large_and_wide_components(spark):
    rng = np.random.default_rng(8)
    scales = [1.0, 3e6, 1e10, 1e17, 1e30]
    rows = [(i, (rng.normal(size=5) * scales[i % 5]).astype(np.float32).astype(float).tolist()) for i in range(300)] + [(400, [2.0**481, 0.0, 0.0, 0.0, 0.0]), (500, [-1e300] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in M.search(spark, df, df.where("vec_id % 20 = 0")).collect())
    exact = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows[:300]]
    want = []
    for i, q in exact[::20]:
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in exact if j != i)[:10]
        want += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best, 1)]
    assert got == want
    values = [0, 1, -1, 255, 256, -256, 2**70, -(2**70), 5, -5]
    assert sorted(values, key=M.order_of) == sorted(values)


def test_cells_split_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 50)
    v = clustered(6, 80, 8)
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)] + [(0, v[0].astype(np.float32).tolist())] * 240 + [(1000 + i, [0.5] * 8) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in M.search(spark, df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)


def test_many_blocks_of_queries_leave_the_plan_as_it_is(spark, monkeypatch):
    import os

    rng = np.random.default_rng(11)
    vectors = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(120)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 5 = 0")
    whole = M.search(spark, vectors, asked, 4)
    monkeypatch.setattr(M, "QUERY_BYTES", 8 * 6 * 7)  # seven queries at a time, four rounds
    parts = M.search(spark, vectors, asked, 4)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 96
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(parts) == plan(whole)
    assert not [f for f in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if f.startswith("top-k-")]


def test_queries_enter_pages_together(monkeypatch):
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.integers(-9, 9, (300, 4)) + c for c in rng.integers(-500, 500, (10, 4))]).astype(float)
    v[::7] = v[0]  # equal vectors, ties at every rank
    ids = rng.permutation(len(v))
    tree = M.MTree(ids, v)
    calls = []
    monkeypatch.setattr(M.MTree, "scores", lambda self, rows, queries, f=M.MTree.scores: calls.append(len(queries)) or f(self, rows, queries))
    asked = np.concatenate([v[:200], rng.integers(-500, 500, (50, 4)), v[:1] * 2.0**60])
    names = np.concatenate([ids[:200], [-1] * 51])
    got = tree.tops(names, asked, 10, np.full(len(asked), -np.inf))
    assert max(calls) == M.TOGETHER and len(calls) < len(asked)
    for name, q, found in zip(names.tolist(), asked.tolist(), got, strict=True):
        exact = sorted(((-sum(int(a) * int(b) for a, b in zip(q, x, strict=True)), i) for i, x in zip(ids.tolist(), v.tolist(), strict=True) if i != name))[:10]
        assert sorted(((-s, i) for s, i in found)) == exact
        assert sorted(tree.top(name, q, 10)) == sorted(found)
    assert tree.tops(names[:0], asked[:0], 10, np.zeros(0)) == [] and M.MTree(ids[:0], v[:0]).tops(names[:2], asked[:2], 3, np.zeros(2)) == [[], []]
    few = tree.tops(names, asked, 10, np.array([np.sort(v @ q)[-3] for q in asked]))
    for a, b in zip(got, few, strict=True):
        assert sorted(a, reverse=True)[:3] == sorted(b, reverse=True)[:3]
