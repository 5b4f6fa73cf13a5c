"""Exact top-k by inner product with M-trees (operator 10).

Vectors become integers, ``floor(scale * x)``. One more component, ``sqrt(M**2 - |v|**2)`` with M
the block's longest vector, puts all on a sphere, where a larger inner product is a smaller
distance, so a metric tree applies. Each block of at most ``BLOCK`` vectors carries an M-tree:
routing nodes with a vector, a covering radius and their distance to the parent, leaf pages with
the entries' distances to the page's vector. The search takes pages best first; a node or an
entry whose stored distances already show that it lies beyond the k-th best, by the triangle
inequality, is passed over without computing its distance. Ties at the k-th score are all looked at.

The stated queries meet every block as packed rows, in packs that grow with their number; each piece
of work returns its k best, which a window merges. Nothing is sampled.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do null ids; shorter vectors count as filled up with zeros; a query is never its own candidate
(rows of its id); repeated query rows are one query (of several vectors of one id the least, by components) and repeated
candidates separate ones.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seriesforge.llm.common import written
from seriesforge.llm.vectors import packs, usable, width_of

BLOCK = 8192
#: Queries of a pack: an eighth of all, within these bounds. A block is read once for each pack.
QUERIES, MOST_QUERIES = 256, 4096
PAGE = 128
FAN = 16


class MTree:
    """An M-tree over the rows of ``points``. Nodes are (vector row, radius, distance to the
    parent's vector, children or None, entry rows, entry distances)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self.node(np.arange(len(points)), None)

    def distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[to]) ** 2).sum(1))

    def node(self, rows: np.ndarray, parent: int | None):
        middle = self.points[rows].mean(0)
        own = int(rows[((self.points[rows] - middle) ** 2).sum(1).argmin()])
        d = self.distances(rows, own)
        up = 0.0 if parent is None else float(np.sqrt(((self.points[own] - self.points[parent]) ** 2).sum()))
        if len(rows) <= PAGE or d.max() == 0:
            return own, float(d.max()), up, None, rows, d
        picked, far = [own], d
        for _ in range(min(FAN, -(-len(rows) // PAGE)) - 1):  # each next one is the farthest from those before
            picked.append(int(rows[far.argmax()]))
            far = np.minimum(far, self.distances(rows, picked[-1]))
        near = np.stack([self.distances(rows, p) for p in picked]).argmin(0)
        children = [self.node(rows[near == c], own) for c in range(len(picked)) if (near == c).any()]
        return own, float(d.max()), up, children, None, None


def search(tree: MTree, ids: np.ndarray, vectors: np.ndarray, longest: float, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, score, id) of the k best of a block for each of a pack of queries, without a
    query's own id. Best first for the pack: the next node is the one that some query may have to
    see with the smallest bound, and it is worked on for just the queries that its stored distances
    don't rule out."""
    m = len(queries)
    sphere = (queries.astype(float) ** 2).sum(1) + longest**2
    slack = 1e-7 * (1 + np.sqrt(sphere))
    at = np.concatenate([queries.astype(float), np.zeros((m, 1))], 1)
    # Doubles hold the products exactly, unless components are huge.
    exact = np.abs(vectors).max() * float(np.abs(queries).max()) * vectors.shape[1] < 2**52
    left, right = (vectors.astype(float), queries.astype(float)) if exact else (vectors, queries)
    best: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    least, reach = np.full(m, -np.inf), np.full(m, np.inf)

    def distance(row: int, who: np.ndarray) -> np.ndarray:
        return np.sqrt(((at[who] - tree.points[row]) ** 2).sum(1))

    everyone = np.arange(m)
    d = distance(tree.root[0], everyone)
    bound = np.maximum(d - tree.root[1], 0)
    queue, count = [(bound.min(), 0, tree.root, everyone, d, bound)], 0
    while queue:
        _, _, (_, _, _, children, rows, apart), who, d, bound = heapq.heappop(queue)
        open_ = bound <= reach[who] + slack[who]
        if not open_.any():
            continue
        who, d = who[open_], d[open_]
        if children is None:
            near = np.abs(d[:, None] - apart) <= (reach[who] + slack[who])[:, None]
            near &= ids[rows] != query_ids[who][:, None]
            some = near.any(0)
            near, rows = near[:, some], rows[some]
            scores = np.where(near, right[who] @ left[rows].T, -np.inf if exact else np.iinfo(np.int64).min)
            for x in np.flatnonzero((near & (scores >= least[who][:, None])).any(1)):
                q, worth = who[x], near[x] & (scores[x] >= least[who[x]])
                found, names = scores[x, worth], ids[rows[worth]]
                order = np.lexsort((names, -found))[:k]
                best[q] = sorted([*best[q], *zip(found[order].astype(np.int64).tolist(), names[order].tolist())], key=lambda e: (-e[0], e[1]))[:k]
                if len(best[q]) == k:
                    least[q] = best[q][-1][0]
                    reach[q] = np.sqrt(max(sphere[q] - 2 * least[q], 0.0))
            continue
        for c in children:
            able = np.abs(d - c[2]) - c[1] <= reach[who] + slack[who]  # by the parent's distance alone
            if able.any():
                e = distance(c[0], who[able])
                low = np.maximum(e - c[1], 0)
                count += 1
                heapq.heappush(queue, (low.min(), count, c, who[able], e, low))
    return [(int(i), s, o) for i, found in zip(query_ids, best) for s, o in found]


def top_k(df: DataFrame, is_query, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score) for the rows of ``df`` where ``is_query`` holds, against all."""
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("id"), F.when(is_query, 1).otherwise(0).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable("v"))
    width = width_of(rows, "v")

    def packed(n: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, _, v in packs(batches, width, n):
                v = np.floor(scale * v)
                tree = b""
                if n == BLOCK:
                    norms = (v**2).sum(1)
                    tree = MTree(np.concatenate([v, np.sqrt(norms.max() - norms)[:, None]], 1))
                    tree = pickle.dumps((tree.root, float(np.sqrt(norms.max()))))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.astype(np.int64).tobytes(), v.astype(np.int64).tobytes(), tree)], ["ids", "v", "tree"])

        return pack

    schema = "ids binary, v binary, tree binary"
    blocks = written(rows.mapInArrow(packed(BLOCK), schema), "blocks")
    asked = written(rows.where("q = 1").groupBy("id", "q").agg(F.min("v").alias("v")), "asked")  # one query an id: its least vector
    size = min(max(QUERIES, asked.count() // 8), MOST_QUERIES)
    asked = written(asked.mapInArrow(packed(size), schema).withColumn("pack", F.monotonically_increasing_id()), "queries")
    # Every block meets every pack of queries; both sides are packed, so these are few rows.
    n_packs, n_blocks = asked.count(), blocks.count()
    work = blocks.crossJoin(F.broadcast(asked.select("pack")))  # only the packs' ids
    work = work.join(asked.select("pack", F.col("ids").alias("q_ids"), F.col("v").alias("q_v")), "pack").repartition(max(1, min(n_packs * n_blocks, 4 * spark.sparkContext.defaultParallelism)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*batch.columns):
                ids, v, tree, q_ids, q_v = (c.as_buffer() for c in cells)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                v, q_v = np.frombuffer(v, np.int64).reshape(len(ids), -1), np.frombuffer(q_v, np.int64).reshape(len(q_ids), -1)
                norms = (v.astype(float) ** 2).sum(1)
                own = MTree.__new__(MTree)
                own.root, longest = pickle.loads(tree)
                own.points = np.concatenate([v.astype(float), np.sqrt(norms.max() - norms)[:, None]], 1)
                found = search(own, ids, v, longest, q_v, q_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3, ["query_id", "score", "vec_id"])

    found = work.select("ids", "v", "tree", "q_ids", "q_v").mapInArrow(searched, "query_id long, score long, vec_id long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec_id").alias(id), "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of all ``embeddings`` for every row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
