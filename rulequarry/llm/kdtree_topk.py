"""Exact top-k inner products with KD-trees per shard.

Vectors are dealt to shards of a bounded size by a hash of their id. A shard's tree splits at the median of the widest
dimension and keeps a tight bounding box for every node. A query visits the leaves best bound first, where a box's
bound is the largest inner product that any point of the box could have, and stops when no bound reaches its kth score
so far. Every query is first answered in one shard; its kth score there is propagated to all other shards, whose
searches start from it. All arithmetic is on integers that double precision holds exactly, else on Python's integers.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do rows without an
id; of rows that share an id, the one with the smallest vector stands; vectors of different lengths are not compared;
equal scores go to the smaller ids; other columns, whatever their names, are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulequarry.llm.common import stored

K = 5
EVERY = 50
SCALE = 256
#: Vectors of a shard, about; and of a leaf.
SHARD = 2048
LEAF = 64
#: Queries that a shard answers at once.
BATCH = 512
#: Products and their sums below this are exact in double precision.
EXACT = 2.0**52


class Tree:
    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.exact = not len(points) or float(np.abs(points).max(initial=0)) ** 2 * points.shape[1] < EXACT
        order = np.arange(len(ids))
        self.low, self.high, self.left, self.right, self.span = [], [], [], [], []
        self._split(points, order, 0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, points: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        node = len(self.left)
        own = points[order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        for part, x in ((self.low, low), (self.high, high), (self.left, -1), (self.right, -1), (self.span, (a, b))):
            part.append(x)
        width = high - low
        if b - a > LEAF and width.max() > 0:
            axis, mid = int(width.argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid, kind="introselect")]
            self.left[node] = self._split(points, order, a, a + mid)
            self.right[node] = self._split(points, order, a + mid, b)
        return node

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query number, id, score) of each query's k best here that reach its least score."""
        if self.exact and float(np.abs(queries).max(initial=0)) * float(np.abs(self.points).max(initial=0)) * self.points.shape[1] < EXACT:
            low, high, points, queries = self.low, self.high, self.points, queries
        else:
            low, high, points, queries = (np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (self.low, self.high, self.points, queries))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        for n in range(len(queries)):
            q, own, bound = queries[n], ids[n], bounds[n]
            best: list[tuple] = []  # (score, -id), the worst first
            floor = least[n]
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < floor:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= floor:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.span[node]
                scores = points[a:b] @ q
                for i in np.flatnonzero(scores >= floor):
                    if self.ids[a + i] == own:
                        continue
                    item = (scores[i], -self.ids[a + i])
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            for score, negative in best:
                yield n, -int(negative), int(score)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (shard, kind, vec_id): a shard's vectors (kind 0), then its queries (kind 1)."""
    shard, ids, points, tree, asked = None, [], [], None, []

    def answers() -> pd.DataFrame:
        nonlocal tree
        if tree is None and ids:
            tree = Tree(np.array(ids), np.array(points, dtype=np.float64))
        some = list(tree.search(np.array([a[0] for a in asked]), np.array([a[1] for a in asked], dtype=np.float64), np.array([a[2] for a in asked]), k)) if tree else []
        out = pd.DataFrame({"query_id": [asked[n][0] for n, _, _ in some], "vec_id": [v for _, v, _ in some], "score": [s for _, _, s in some]}, dtype="int64")
        asked.clear()
        return out

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "vec_id", "v", "least")), strict=True)
        for at, kind, vec, v, least in rows:
            if at != shard:
                if asked:
                    yield answers()
                shard, ids, points, tree = at, [], [], None
            if kind == 0:
                ids.append(vec)
                points.append(v)
            else:
                asked.append((vec, v, -np.inf if least is None else least))
                if len(asked) >= BATCH:
                    yield answers()
    if asked:
        yield answers()


def _run(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = vectors.select("shard", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("least")).unionByName(queries.select("shard", F.lit(1).alias("kind"), "vec_id", "v", "least"))

    def run(batches):
        for pdf in _search(batches, k):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    return both.repartition(parts, "shard").sortWithinPartitions("shard", "kind", "vec_id").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, the k largest inner products with other rows."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    sound = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = table.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("_v")).groupBy("vec_id").agg(F.min("_v").alias(vector_col))
    vectors = stored(rows.select("vec_id", whole.alias("v"), F.size(vector_col).alias("d")), "vectors")
    shards = max(1, -(-vectors.count() // shard_size))
    # A shard's number leads with the length, so vectors of different lengths never meet.
    number = lambda part: F.concat_ws(":", "d", part.cast("string"))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    placed = vectors.select("vec_id", "v", "d", home.alias("home"), number(home).alias("shard"))
    queries = placed.where(F.col("vec_id") % every == 0)
    first = stored(_run(placed, queries.withColumn("least", F.lit(None).cast("double")), k), "home")
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("kth")).cast("double").alias("least"))
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda i: i != F.col("home")))
    rest = queries.select("vec_id", "v", "d", others.alias("other")).select("vec_id", "v", number(F.col("other")).alias("shard")).join(kth, F.col("vec_id") == F.col("query_id"), "left").select("shard", "vec_id", "v", "least")
    found = first.unionByName(_run(placed, rest, k))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
