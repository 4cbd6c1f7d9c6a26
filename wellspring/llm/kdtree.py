"""Exact top-k by inner product: a KD-tree in each shard, searched best-first.

Vectors are dealt into shards by a hash of their id; each shard builds a KD-tree by median
splits along its widest dimension, every node with the tight box of its vectors. The
greatest inner product a query can have with a box is the sum over dimensions of the larger
of its products with the box's two sides. A search opens the node with the greatest bound
first, keeps its k best, and ends when no bound reaches the k-th.

Each query is first searched in its own shard. Its k-th score from there travels with it to
all other shards, where it closes most boxes at once. Queries meet the shards in blocks, so
a task holds one shard and one block; a query's candidates are merged by rank at the end.

Defined cases: a vector that is null or holds null or non-finite components takes no part,
nor does a row without an id; a query meets every row with another id; rows that repeat
an id and a vector are candidates each, and rows that repeat a query's id are one query
(that of the greatest vector); shorter vectors count as filled up with zeros; equal scores go to the
smaller id; fewer than k candidates give fewer rows; an empty table gives no rows; other
columns are ignored. Scores have to fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import narrow, written

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 16_384, 256
#: The k-th score of a query that has fewer than k candidates so far: no score is less.
UNKNOWN = -(2**63)
_FOUND = "query_id long, vec_id long, score long"


def quantized(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and the vector of floor(scale * x), of rows that take part."""
    rows = narrow(table, vec_id=id_col, vector=vector_col)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"),
    )


@dataclass
class Tree:
    """Nodes in arrays: boxes, children (-1: none) and rows of the leaves."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: list[int]
    right: list[int]
    rows: list[tuple[int, int]]

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        order, low, high, left, right, rows = np.arange(len(ids)), [], [], [], [], []

        def node(start: int, stop: int) -> int:
            own, at = vectors[order[start:stop]], len(rows)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            rows.append((start, stop))
            left.append(-1)
            right.append(-1)
            wide = high[at] - low[at]
            if stop - start > leaf and wide.size and wide.max() > 0:
                middle = (stop - start) // 2
                part = np.argpartition(own[:, int(wide.argmax())], middle)
                order[start:stop] = order[start:stop][part]
                left[at], right[at] = node(start, start + middle), node(start + middle, stop)
            return at

        node(0, len(ids))
        return cls(ids[order], np.ascontiguousarray(vectors[order]), np.array(low), np.array(high), left, right, rows)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, kth: np.ndarray) -> Iterator[tuple]:
        """(query id, ids, scores) of each query's candidates at or above its ``kth`` score."""
        positive, negative = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        high, low = self.high.T.astype(float), self.low.T.astype(float)
        bounds = positive @ high + negative @ low
        # a sum of doubles falls short by at most so much of the sum of its terms' sizes,
        # which cancelling terms leave far greater than the sum itself
        bounds += (queries.shape[1] + 4) * 2.0**-51 * (positive @ np.abs(high) - negative @ np.abs(low))
        for query, own, least, bound in zip(queries, query_ids.tolist(), kth.tolist(), bounds.tolist()):
            best_ids, best_scores, floor = np.empty(0, np.int64), np.empty(0, np.int64), least
            frontier = [(-bound[0], 0)]
            while frontier and -frontier[0][0] >= floor:
                _, at = heapq.heappop(frontier)
                if self.left[at] >= 0:
                    for child in (self.left[at], self.right[at]):
                        if bound[child] >= floor:
                            heapq.heappush(frontier, (-bound[child], child))
                    continue
                start, stop = self.rows[at]
                scores = self.vectors[start:stop] @ query
                near = np.flatnonzero(scores >= floor)
                if not len(near):
                    continue
                ids, scores = self.ids[start:stop][near], scores[near].astype(np.int64)
                other = ids != own
                best_ids = np.concatenate((best_ids, ids[other]))
                best_scores = np.concatenate((best_scores, scores[other]))
                if len(best_ids) >= k:
                    top = np.lexsort((best_ids, -best_scores))[:k]
                    best_ids, best_scores = best_ids[top], best_scores[top]
                    if len(top) == k:
                        floor = max(floor, int(best_scores[-1]))
            yield own, best_ids, best_scores


def _matrix(rows: pa.Table, column: str, width: int) -> np.ndarray:
    lists = rows.column(column).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _search(k: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not shard.num_rows or not queries.num_rows:
            return empty
        width = max(int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max()) for t in (shard, queries))
        vectors, wanted = _matrix(shard, "vector", width), _matrix(queries, "vector", width)
        # doubles multiply faster and are exact as long as sums stay below 2^53
        greatest = float(np.abs(vectors).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * max(width, 1)
        kind = np.float64 if greatest < 2.0**52 else np.int64
        tree = Tree.build(shard.column("vec_id").to_numpy(), vectors.astype(kind))
        kth = queries.column("kth").to_numpy(zero_copy_only=False)
        found = [(q, i, s) for q, i, s in tree.search(wanted.astype(kind), queries.column("vec_id").to_numpy(), k, kth) if len(i)]
        if not found:
            return empty
        return pa.table(
            {
                "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]),
                "vec_id": np.concatenate([i for _, i, _ in found]),
                "score": np.concatenate([s for _, _, s in found]),
            }
        )

    return run


def top_k(
    table: DataFrame, is_query: str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score; ``is_query`` is an SQL condition on ``vec_id``."""
    vectors = written(quantized(table, id_col, vector_col, scale))
    total = vectors.count()
    shards = max(1, -(-total // shard_rows))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)))
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    asked = written(asked.withColumn("home", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards))))

    unknown = asked.withColumn("kth", F.lit(UNKNOWN).cast("long"))
    home = written(
        unknown.withColumnRenamed("home", "shard").groupBy("shard").cogroup(placed.groupBy("shard"))
        .applyInArrow(_swapped(k), _FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # the k-th score so far; of fewer than k candidates nothing is known yet
    floor = home.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("kth")
    )
    blocks = max(1, -(-asked.count() // block_rows))
    travelling = asked.join(floor, "vec_id", "left").select(
        "vec_id", "vector", F.coalesce("kth", F.lit(UNKNOWN)).alias("kth"), "home",
        F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).alias("block"),
    )
    every = travelling.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).where("shard <> home").drop("home")
    met = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    away = every.groupBy("shard", "block").cogroup(met.groupBy("shard", "block")).applyInArrow(_swapped(k), _FOUND)
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _swapped(k: int):
    search = _search(k)

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        return search(shard, queries)

    return run
