"""Exact top-k by inner product: a KD-tree per shard, best-first with bounds, a kth score passed on.

Vectors are dealt to shards, queries to blocks, and one task holds one shard and one block. In the
task a KD-tree is built by median splits of the widest axis, with the tight bounding box of every
node. For a query the largest inner product a box can hold is known from the box's corners, so
nodes are taken in the order of their bounds until no bound beats the kth best score. That score
starts from the kth best of a fixed pilot of the vectors, which every query meets first, so a
shard can be skipped as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.llm.common import small_batches, written

K = 5
#: Vectors of a shard, queries of a block, vectors of the pilot, points of a leaf.
SHARD = 8192
QUERIES = 2048
PILOT = 2048
LEAF = 64


@dataclass
class Node:
    """A box: its corners, smallest id, and two children or the rows of a leaf."""

    low: np.ndarray
    high: np.ndarray
    least_id: int
    rows: np.ndarray | None
    children: tuple[int, int] | None = None


class KDTree:
    """Points with ids; splits at the median of the widest axis. Equal points stay in one leaf, however many."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.nodes = ids[order], points[order], []
        if len(ids):
            self._grow(np.arange(len(ids)), leaf)
            self.low = np.array([n.low for n in self.nodes])
            self.high = np.array([n.high for n in self.nodes])

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        own = self.points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.nodes)
        node = Node(low, high, int(self.ids[rows[0]]), rows)
        self.nodes.append(node)
        axis = int((high - low).argmax()) if len(low) else 0
        if len(rows) > leaf and len(low) and low[axis] < high[axis]:
            middle = np.median(own[:, axis])
            left = own[:, axis] <= middle
            if left.all():
                left = own[:, axis] < middle
            node.rows = None
            node.children = self._grow(rows[left], leaf), self._grow(rows[~left], leaf)
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int | None, k: int, floor: float, bounds: np.ndarray) -> list[tuple[float, int]]:
        """The k best (score, id) with a score of ``floor`` or more, ties to the smaller id; ``own`` is left out."""
        best: list[tuple[float, int]] = []  # a heap: the worst first
        queue = [(-bounds[0], 0)]
        while queue:
            bound, at = heapq.heappop(queue)
            bound = -bound
            if bound < floor or len(best) == k and bound < best[0][0]:
                break
            node = self.nodes[at]
            if len(best) == k and bound == best[0][0] and node.least_id > -best[0][1]:
                continue  # could only tie, with larger ids
            if node.children:
                for child in node.children:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = self.points[node.rows] @ query
            fit = scores >= max(floor, best[0][0] if len(best) == k else floor)
            if own is not None:
                fit &= self.ids[node.rows] != own
            found, ids = scores[fit], self.ids[node.rows[fit]]
            if len(found) > k:
                top = np.lexsort((ids, -found))[:k]
                found, ids = found[top], ids[top]
            for score, i in zip(found.tolist(), ids.tolist()):
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
        return [(s, -i) for s, i in best]


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def quantized(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, itself left out.

    Both have (vec_id, v), v an array of whole numbers as doubles, small enough for exact sums. Ties go
    to the smaller vec_id. Vectors of another length than the query's don't meet it. Fewer than k
    candidates are all returned; empty tables give no rows. Rows with a null vec_id or v are left out;
    of rows that repeat a vec_id all count as candidates, and a repeated query is answered once.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    has = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    vectors = written(vectors.filter(has).select(F.col("vec_id").cast("bigint").alias("vec_id"), "v", F.size("v").alias("dim")))
    queries = queries.filter(has).select(F.col("vec_id").cast("bigint").alias("vec_id"), "v", F.size("v").alias("dim"))
    queries = written(queries.groupBy("vec_id").agg(F.min("v").alias("v"), F.min("dim").alias("dim")))
    # (dim, rows) of each length of vector: lengths are few
    parts = []
    for dim, n in sorted((r["dim"], r["count"]) for r in vectors.groupBy("dim").count().collect()):
        asked = queries.filter(F.col("dim") == dim)
        if dim and (m := asked.count()):
            parts.append(_one_length(vectors.filter(F.col("dim") == dim), n, asked, m, dim, k))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = parts[0]
    for other in parts[1:]:
        out = out.union(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score"))


def _one_length(vectors: DataFrame, n: int, queries: DataFrame, m: int, dim: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // QUERIES))
    # a fixed number of vectors, the first by id: they only set where the search may stop
    first = vectors.orderBy("vec_id").limit(PILOT).toPandas()
    pilot = spark.sparkContext.broadcast((first["vec_id"].to_numpy(np.int64), np.array(first["v"].tolist(), dtype=np.float64)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = pilot.value
        for batch in batches:
            own = np.asarray(batch.column("vec_id"))
            scores = _matrix(batch.column("v"), dim) @ points.T
            scores[own[:, None] == ids[None, :]] = -np.inf
            if scores.shape[1] >= k:
                floor = np.partition(scores, -k, axis=1)[:, -k]
            else:
                floor = np.full(len(own), -np.inf)
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(floor)], names=["vec_id", "v", "floor"])

    asked = queries.select("vec_id", "v").mapInArrow(floors, "vec_id bigint, v array<double>, floor double")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stock = vectors.select(shard.alias("shard"), every(blocks).alias("block"), F.lit(None).cast("double").alias("floor"), "vec_id", "v")
    asked = asked.select(every(shards).alias("shard"), block.cast("int").alias("block"), "floor", "vec_id", "v")
    rows = stock.select(F.col("shard").cast("int"), F.col("block").cast("int"), "floor", "vec_id", "v", F.lit(0).alias("role")).unionByName(
        asked.withColumn("role", F.lit(1))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, points, tree = None, [], [], None
        for batch in batches:
            head = np.stack([np.asarray(batch.column(c)) for c in ("shard", "block", "role")])
            cut = np.r_[0, np.flatnonzero((np.diff(head, axis=1) != 0).any(axis=0)) + 1, batch.num_rows]
            for low, high in zip(cut[:-1], cut[1:]):
                shard, block, role = head[:, low].tolist()
                if (shard, block) != key:
                    key, ids, points, tree = (shard, block), [], [], None
                part = batch.slice(low, high - low)
                v, own = _matrix(part.column("v"), dim), np.asarray(part.column("vec_id"))
                if role == 0:
                    ids.append(own), points.append(v)
                elif ids:
                    tree = tree or KDTree(np.concatenate(ids), np.concatenate(points))
                    yield _answers(tree, own, v, np.asarray(part.column("floor")), k)

    keys = ["shard", "block"]
    dealt = rows.repartition(shards * blocks, *keys).sortWithinPartitions(*keys, "role")
    return dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score double")


def _answers(tree: KDTree, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> pa.RecordBatch:
    query, vec, score = [], [], []
    for low in range(0, len(ids), 256):
        bounds = tree.bounds(queries[low : low + 256])
        for i, row in enumerate(bounds, start=low):
            for s, v in tree.search(queries[i], int(ids[i]), k, float(floors[i]), row):
                query.append(int(ids[i])), vec.append(v), score.append(s)
    return pa.record_batch([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])
