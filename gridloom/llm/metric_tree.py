"""Exact top-k by inner product over M-trees.

Vectors are dealt to cells by their nearest routing vector (from a bounded
sample), large cells to several shards. A shard's M-tree has pages of metric
nodes with routing vectors, covering radii and distances to the parent. One more
coordinate gives all vectors of a shard the same norm, so the nearest vectors
are those with the largest inner products. A query first asks its own cell; its
score there is the bound with which it meets the other shards, most of which
their covering radius then rules out. It walks pages best first; stored parent
distances rule out entries by the triangle inequality before any distance is
computed. Scores are exact integers, and a bound only rules out what can't even tie.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import tables

PAGE, FAN = 512, 32
#: Queries that enter a page together at most.
TOGETHER = 64
#: Vectors of a shard aimed at; bytes of queries sent to the tasks at once; bytes of routing vectors at most, and sampled vectors for each.
SHARD_ROWS, QUERY_BYTES, ROUTE_BYTES, SAMPLED = 8192, 8 << 20, 1 << 20, 8
#: Components beyond it, which only a double can hold, keep a vector out.
WIDEST = 2.0**480


@dataclass
class Node:
    """A page: entries' distances to its routing vector, and for inner pages the children's routing vectors and radii."""

    parent: np.ndarray
    points: np.ndarray
    radii: np.ndarray | None
    children: list[Node] | None
    rows: np.ndarray | None


class MTree:
    """`vectors` are whole numbers as doubles, one row each; equal vectors are one entry with their ids in order.

    `computed` counts the distances and scores worked out so far.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        self.ids = np.split(ids, at[1:])
        self.vectors = vectors[at]
        norms = (self.vectors**2).sum(axis=1)
        self.limit = float(norms.max(initial=0.0))
        full = np.column_stack([self.vectors, np.sqrt(np.maximum(self.limit - norms, 0))])
        self.widest = float(np.abs(self.vectors).max(initial=0))
        self.root_point = full.mean(axis=0) if len(full) else np.zeros(vectors.shape[1] + 1)
        self.reach = float(np.sqrt(((full - self.root_point) ** 2).sum(axis=1).max(initial=0.0)))
        self.computed = 0
        self.root = self._page(np.arange(len(full)), full, self.root_point)

    def _page(self, rows: np.ndarray, full: np.ndarray, routing: np.ndarray) -> Node:
        if len(rows) <= PAGE:
            return Node(np.sqrt(((full[rows] - routing) ** 2).sum(axis=1)), full[rows], None, None, rows)
        seeds = [int(np.argmax(((full[rows] - routing) ** 2).sum(axis=1)))]
        near = ((full[rows] - full[rows[seeds[0]]]) ** 2).sum(axis=1)
        owner = np.zeros(len(rows), int)
        while len(seeds) < FAN and near.max() > 0:  # the farthest from all seeds so far
            seeds.append(int(near.argmax()))
            d = ((full[rows] - full[rows[seeds[-1]]]) ** 2).sum(axis=1)
            owner[d < near] = len(seeds) - 1
            near = np.minimum(near, d)
        points, radii, children = [], [], []
        for k in range(len(seeds)):
            own = rows[owner == k]
            if len(own):
                p = full[own].mean(axis=0)
                points.append(p)
                radii.append(np.sqrt(((full[own] - p) ** 2).sum(axis=1).max()))
                children.append(self._page(own, full, p))
        points = np.array(points)
        return Node(np.sqrt(((points - routing) ** 2).sum(axis=1)), points, np.array(radii), children, None)

    def near(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Places of the queries that may find a score of at least their floor here, by the covering radius of the whole tree."""
        if not len(self.vectors):
            return np.zeros(0, int)
        length = (queries**2).sum(axis=1)
        there = np.sqrt(((queries - self.root_point[:-1]) ** 2).sum(axis=1) + self.root_point[-1] ** 2)
        self.computed += len(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.sqrt(np.maximum(0.0, length + self.limit - 2.0 * floors))
        return np.flatnonzero(there - self.reach <= bound + self._slack(length))

    def _slack(self, length: np.ndarray | float) -> np.ndarray | float:
        return 1e-7 * (1 + np.sqrt(length) + np.sqrt(self.limit))

    def scores(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact scores, a row for each of `rows`, a column for each query; as Python integers where doubles can't hold them."""
        self.computed += len(rows) * len(queries)
        found = self.vectors[rows]
        if self.widest * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2**53:
            return found @ queries.T
        whole = np.array([list(map(int, v)) for v in found.tolist()], object)
        return whole @ np.array([list(map(int, q)) for q in queries.tolist()], object).T

    def top(self, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the k best ids other than `query_id`, ties to smaller ids; what is below `floor` may be left out."""
        return self.tops(np.array([query_id]), np.asarray(query, float)[None], k, np.array([floor], float))[0]

    def tops(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        """What top() says of each query.

        Each walks pages best first by a queue of its own; those that stand before the same page enter it together, TOGETHER of
        them at a time in the order of their distances to it, so that scores are products of matrices.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in queries]  # least first, as (score, -id)
        if not len(self.vectors):
            return best
        queries = queries.astype(float)
        full = np.column_stack([queries, np.zeros(len(queries))])
        length = (queries**2).sum(axis=1)
        slack = self._slack(length)
        bound = np.sqrt(np.maximum(0.0, length + self.limit - 2.0 * floors))
        there = np.sqrt(((full - self.root_point) ** 2).sum(axis=1))
        queues = [[(0.0, 0, x, self.root)] for x in there.tolist()]
        active, tick = range(len(queries)), 0
        while active:
            pages: dict[int, tuple[Node, list[tuple[float, int]]]] = {}
            for i in active:
                low, _, x, node = heapq.heappop(queues[i])
                if low <= bound[i] + slack[i]:
                    pages.setdefault(id(node), (node, []))[1].append((x, i))
                else:
                    queues[i] = []  # it and all after it are too far
            for node, before in pages.values():
                before.sort()
                for at in range(0, len(before), TOGETHER):
                    there = np.array([x for x, _ in before[at : at + TOGETHER]])
                    those = np.array([i for _, i in before[at : at + TOGETHER]])
                    reach = bound[those] + slack[those]
                    least = np.abs(there[:, None] - node.parent) - (0 if node.radii is None else node.radii)
                    live = least <= reach[:, None]  # others are too far by the triangle inequality
                    if node.children is None:
                        rows = node.rows[live.any(axis=0)]
                        self._improve(rows, those, query_ids, queries, k, best)
                        for i in those.tolist():
                            if len(best[i]) == k:
                                bound[i] = min(bound[i], float(np.sqrt(max(0.0, length[i] + self.limit - 2.0 * best[i][0][0]))))
                        continue
                    self.computed += int(live.sum())
                    asked, child = np.nonzero(live)
                    far = np.sqrt(((node.points[child] - full[those[asked]]) ** 2).sum(axis=1))
                    near = np.maximum(0.0, far - node.radii[child])
                    for j in np.flatnonzero(near <= reach[asked]).tolist():
                        tick += 1
                        heapq.heappush(queues[those[asked[j]]], (float(near[j]), tick, float(far[j]), node.children[child[j]]))
            active = [i for i in active if queues[i]]
        return [[(s, -i) for s, i in b] for b in best]

    def _improve(self, rows: np.ndarray, those: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Puts into `best` of those queries what the entries `rows` better."""
        if not len(rows):
            return
        exact = self.scores(rows, queries[those])
        scores = exact.astype(float, copy=False)  # rounding keeps their order
        worst = np.array([float(best[i][0][0]) if len(best[i]) == k else -np.inf for i in those.tolist()])
        if len(rows) > k + 1:  # the query itself may be one of the entries
            worst = np.maximum(worst, np.partition(scores, -k - 1, axis=0)[-k - 1])
        for column, row in zip(*(x.tolist() for x in np.nonzero(scores.T >= worst[:, None])), strict=True):
            i, s = int(those[column]), int(exact[row, column])
            mine, own = best[i], int(query_ids[i])
            for other in self.ids[rows[row]][: k + 1].tolist():
                if other == own:
                    continue
                if len(mine) < k:
                    heapq.heappush(mine, (s, -other))
                elif (s, -other) > mine[0]:
                    heapq.heapreplace(mine, (s, -other))
                else:
                    break


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of each vector, exact in doubles; shorter ones are filled with 0."""
    values = np.floor(1024.0 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    size = np.array(column.value_lengths().to_pylist(), int)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = values
    return out


def sound(vector: str) -> Column:
    """Not null, without null, NaN or infinite components, or any beyond WIDEST."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < WIDEST)), F.lit(False))


def order_of(score: int) -> bytes:
    """Bytes that sort like the whole numbers."""
    size = (abs(score).bit_length() + 7) // 8
    return bytes([128 + size]) + score.to_bytes(size, "big") if score >= 0 else bytes([128 - size]) + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def _shown(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def routes(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n routing vectors for a sample: seeds far from each other, moved a few times to the middle of what they attract."""
    if len(sample) <= 1 or n <= 1:
        return sample[:1]
    seeds = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(seeds) < n and near.max() > 0:
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[seeds[-1]]) ** 2).sum(axis=1))
    points = sample[seeds]
    for _ in range(5):
        own = nearest(sample, points)
        for c in np.unique(own).tolist():
            points[c] = sample[own == c].mean(axis=0)
    return points


def nearest(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty(len(vectors), np.int64)
    norms = (points**2).sum(axis=1)
    for a in range(0, len(vectors), 1024):
        out[a : a + 1024] = (norms - 2.0 * (vectors[a : a + 1024] @ points.T)).argmin(axis=1)
    return out


def shard_count(rows: int, partitions: int) -> int:
    """Shards of at most about SHARD_ROWS vectors; more of them, up to `partitions`, only while each has some four pages, as a lone page is searched flat."""
    return max(1, -(-rows // SHARD_ROWS), min(partitions, rows // (4 * PAGE)))


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest scores for each row of `queries`.

    Both have vec_id and embedding. A query's own id is no candidate. Null ids, null vectors and vectors with a
    component that is null, not finite or beyond WIDEST take no part; shorter vectors are filled with zeros; of several
    query rows with one id the one with the least vector counts; repeated rows of `vectors` are rows. Ranks follow the
    exact scores, and one beyond a long is shown as the nearest long. All queries meet all shards, a
    block of queries at a time, so that what is sent to the tasks is bounded; what a block finds is written before the next
    one is sent, so that neither the plan nor what is held grows with the queries. No rows give no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & sound("embedding"))
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & sound("embedding"))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows, width = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = max(width or 0, queries.agg(F.max(F.size("embedding"))).first()[0] or 0)
    points = _routing(vectors, rows, width, shard_count(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    trees = _trees(spark, vectors, width, points)
    folder = f"{tables.shared_folder(spark)}/top-k-{uuid.uuid4().hex}"
    rounds = 0
    for ids, asked in _blocks(queries, width):
        home = (asked @ points.T).argmax(axis=1) if len(points) else np.zeros(len(ids), int)
        first, sent = _ask(spark, trees, ids, asked, k, home, np.full(len(ids), -np.inf), True)
        first = tables.checkpoint(first)
        sent.destroy()
        worst = _best(first, k).where(F.col("rank") == k).select("query_id", "score").collect() if len(points) > 1 else []
        at = np.searchsorted(ids, [r[0] for r in worst])
        floors = np.full(len(ids), -np.inf)
        floors[at] = [2.0**62 if r[1] == 2**63 - 1 else -np.inf if r[1] == -(2**63) else r[1] for r in worst]  # not above the exact score, also where that is beyond a long
        part = first
        if len(points) > 1:
            rest, sent = _ask(spark, trees, ids, asked, k, home, floors, False)
            part = first.union(rest)
        _best(part, k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/round={rounds}")
        if len(points) > 1:
            sent.destroy()
        rounds += 1
    if rounds == 0:
        return _best(spark.createDataFrame([], FOUND), k).select("query_id", "rank", "vec_id", "score")
    found = tables.checkpoint(spark.read.parquet(folder).select("query_id", "rank", "vec_id", "score"))
    tables.remove(spark, folder)
    return found


FOUND = "query_id long, vec_id long, score long, place binary"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _routing(vectors: DataFrame, rows: int, width: int, cells: int) -> np.ndarray:
    """Routing vectors for about `cells` cells, from a sample of bounded size; of one cell it needs none."""
    cells = min(cells, max(1, ROUTE_BYTES // (8 * max(1, width))))
    if cells == 1:
        return np.zeros((1, width))
    share = min(1.0, SAMPLED * cells / rows)
    drawn = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = vectors.where(drawn).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct().orderBy("vec_id", "embedding").limit(2 * SAMPLED * cells).collect()
    return routes(_matrix(pa.array([r[1] for r in sample], pa.list_(pa.float64())), width), cells) if sample else np.zeros((1, width))


def _trees(spark: SparkSession, vectors: DataFrame, width: int, points: np.ndarray) -> DataFrame:
    """(cell, tree): the M-trees of all shards, kept in the shared folder. A cell has a shard for each SHARD_ROWS, or average number, of its vectors."""
    shared = spark.sparkContext.broadcast(points)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = tables.Repeats()
        for b in batches:
            own = nearest(_matrix(b.column("embedding"), width), shared.value) if len(shared.value) > 1 else np.zeros(b.num_rows, np.int64)
            dealt = tables.shares(b.column("dealt").to_numpy(zero_copy_only=False), repeats)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own), pa.array(dealt.view(np.int64))], [*b.schema.names[:-1], "cell", "dealt"])

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        column = t.column("embedding").combine_chunks()
        tree = MTree(t.column("vec_id").combine_chunks().to_numpy(), _matrix(column, width))
        return pa.table({"cell": t.column("cell")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    schema = StructType([*vectors.schema.fields, StructField("cell", LongType()), StructField("dealt", LongType())])
    dealt = vectors.withColumn("dealt", F.xxhash64("vec_id", "embedding")).mapInArrow(cells, schema)
    sizes = {r[0]: r[1] for r in dealt.groupBy("cell").count().collect()}  # as many rows as routing vectors at most
    most = 1 + min(SHARD_ROWS, sum(sizes.values()) // len(points)) * 5 // 4
    parts = F.element_at(F.lit([max(1, -(-sizes.get(c, 0) // most)) for c in range(len(points))]), F.col("cell").cast("int") + 1)
    shard = F.pmod(F.col("dealt"), parts)  # by id and vector; many copies of a row go to all shards of the cell
    return tables.checkpoint(dealt.withColumn("shard", shard).drop("dealt").groupBy("cell", "shard").applyInArrow(build, "cell long, tree binary"))


def _ask(spark: SparkSession, trees: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, home: np.ndarray, floors: np.ndarray, at_home: bool) -> tuple[DataFrame, Broadcast]:
    """What the trees of each query's home cell, or those of all other cells, find for it from its floor on; and what was sent for that."""
    shared = spark.sparkContext.broadcast((ids, asked, home, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, home, floors = shared.value
        for b in batches:
            for cell, raw in zip(b.column("cell").to_pylist(), b.column("tree"), strict=True):
                mine = np.flatnonzero((home == cell) == at_home)
                if len(mine) == 0:
                    continue
                tree = pickle.loads(raw.as_py())
                mine = mine[tree.near(asked[mine], floors[mine])]
                found = zip(ids[mine].tolist(), tree.tops(ids[mine], asked[mine], k, floors[mine]), strict=True)
                out = [(i, other, s) for i, best in found for s, other in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([_shown(r[2]) for r in out], pa.int64()), pa.array([order_of(r[2]) for r in out], pa.binary())], ["query_id", "vec_id", "score", "place"])

    return trees.mapInArrow(run, FOUND), shared


def _blocks(queries: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries as ids and integers, QUERY_BYTES at a time; one partition at a time reaches the driver."""
    most = max(1, QUERY_BYTES // (8 * max(1, width)))
    held: list = []
    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == most:
            yield _block(held, width)
            held = []
    if held:
        yield _block(held, width)


def _block(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda r: r[0])
    return np.array([r[0] for r in rows], np.int64), _matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())), width)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of each query: query_id, rank, vec_id, score. Vectors that are null or have null or non-finite components take no part, nor do null ids; no vectors give no rows."""
    vectors = tables.read(spark, sf_dir, "embeddings")
    return search(spark, vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
