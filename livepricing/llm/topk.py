"""Exact top-k by inner product with KD-trees per shard.

Candidates are dealt by a hash into shards of about ``shard_rows``; each shard gets a KD-tree
(median splits on the widest side, tight bounding boxes). A query walks a tree best-first by the
upper bound of its product with a box and stops when no box can beat its k-th score. First each
query searches its home shard; the k-th score found there goes along to all other shards, so
most of their boxes are never opened. A task reads one sorted stream: a shard's candidates, of
which it builds the tree once, then the queries, ``query_rows`` at a time; it holds one shard and
one such slice however many queries there are. Where there are fewer shards than cores, each
shard is given to several tasks, which share its queries.

Scores are exact integers: products run in float64 while every partial sum stays below 2^53 and
in Python integers beyond. A score beyond the range of a long is the nearest long, for the ranks
too. Components of any finite size take part (256 times one beyond the largest double is the
largest double). Vectors that are null or hold null or non-finite components, and rows without an
id, take no part; a shorter vector counts as padded with zeros; equal rows count once; rows with
a query's own id are not its candidates; ties go to the smaller id. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

RESULT = "query_id long, vec_id long, score long"


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def largest(rows) -> int:
    """The largest absolute component."""
    return max((max(abs(int(min(r))), abs(int(max(r)))) for r in rows if len(r)), default=0)


def matrix(rows, width: int, exact: bool) -> np.ndarray:
    """Integer vectors as rows, padded with zeros or cut; float64, or Python integers if ``exact``."""
    out = np.zeros((len(rows), width), object if exact else np.float64)
    for i, r in enumerate(rows):
        r = r[:width]
        out[i, : len(r)] = [int(x) for x in r] if exact else r
    return out


class KDTree:
    """Boxes in breadth order; ``rows[n]`` is set for leaves, ``kids[n]`` for inner nodes."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.points, self.low, self.high, self.rows, self.kids = points, [], [], [], []
        todo = [np.arange(len(points))]
        for n, idx in enumerate(todo):  # grows while it is walked
            p = points[idx]
            low, high = p.min(axis=0), p.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            spread = high - low
            axis = int(np.argmax(spread)) if len(spread) else 0
            if len(idx) <= leaf or not len(spread) or not spread[axis]:
                self.rows.append(idx)
                self.kids.append(())
                continue
            order = np.argsort(p[:, axis], kind="stable")
            half = len(idx) // 2
            self.rows.append(None)
            self.kids.append((len(todo), len(todo) + 1))
            todo += [idx[order[:half]], idx[order[half:]]]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query, bound, ids: np.ndarray, own: int, k: int, kth) -> list[tuple[int, int]]:
        """The best (score, -id), at most k; only those that can still matter beside ``kth``."""
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            b, n = heapq.heappop(heap)
            floor = best[0][0] if len(best) == k else kth
            if floor is not None and -b < floor:
                break
            if self.rows[n] is None:
                for c in self.kids[n]:
                    heapq.heappush(heap, (-bound[c], c))
                continue
            idx = self.rows[n]
            score = self.points[idx] @ query
            keep = ids[idx] != own
            if floor is not None:
                keep &= np.asarray(score >= floor, bool)
            for s, i in zip(score[keep].tolist(), ids[idx][keep].tolist()):
                item = (min(max(int(s), LEAST), MOST), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


class Shard:
    """The candidates of one shard, with their tree in float64, or in Python integers for queries
    that need them."""

    def __init__(self, ids: np.ndarray, rows: list):
        self.ids, self.rows, self.most = ids, rows, largest(rows)
        self.width = max(map(len, rows), default=0)
        self.trees: dict[bool, KDTree] = {}

    def search(self, queries, k: int):
        """(query, candidate, score) of ``queries``: (id, k-th score or None, vector)."""
        if not len(self.rows):
            return
        most = max(self.most, largest([v for _, _, v in queries]))
        exact = most * most * self.width >= 1 << 51
        if exact not in self.trees:
            self.trees[exact] = KDTree(matrix(self.rows, self.width, exact))
        tree, q = self.trees[exact], matrix([v for _, _, v in queries], self.width, exact)
        bounds = tree.bounds(q)
        for i, (own, kth, _) in enumerate(queries):
            # below the least long all scores tie
            for score, v in tree.search(q[i], bounds[i], self.ids, own, k, None if kth == LEAST else kth):
                yield own, -v, score


def _search(k: int, query_rows: int):
    """Over rows sorted by (shard, part, is_query): a shard's candidates, then its queries."""
    def run(batches):
        at, held, shard = None, [], None
        for pdf in batches:
            for key, rows in pdf.groupby(["shard", "part"], sort=False):
                if key != at:
                    at, held, shard = key, [], None
                ask = rows["is_query"].to_numpy(bool)
                if not ask.all():
                    held.append(rows[~ask])
                asked = rows[ask]
                if not len(asked):
                    continue
                if shard is None:
                    known = pd.concat(held) if held else rows[:0]
                    shard, held = Shard(known["vec_id"].to_numpy(np.int64), [*known["vec"]]), []
                kth = [None if pd.isna(x) else int(x) for x in asked["kth"].tolist()]
                todo = [*zip(asked["vec_id"].tolist(), kth, asked["vec"])]
                for i in range(0, len(todo), query_rows):
                    found = [*shard.search(todo[i: i + query_rows], k)]
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def _meet(candidates: DataFrame, queries: DataFrame, k: int, query_rows: int, shards: int, parts: int) -> DataFrame:
    """query_id, vec_id, score: queries (shard, vec_id, kth as text, vec) against the candidates
    (shard, vec_id, vec) of their shard."""
    cols = ("shard", "part", "is_query", "vec_id", "kth", "vec")
    c = candidates.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("is_query"), "vec_id",
                          F.lit(None).cast("string").alias("kth"), "vec")
    q = queries.select("shard", F.pmod(F.xxhash64(F.lit(1), "vec_id", "vec"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("is_query"),
                       "vec_id", "kth", "vec")
    rows = c.select(*cols).unionByName(q.select(*cols)).repartition(shards * parts, "shard", "part")
    return rows.sortWithinPartitions("shard", "part", "is_query").mapInPandas(_search(k, query_rows), RESULT)


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, vec: floor(scale * component) of the vectors that take part, as whole doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    most = float(np.finfo(np.float64).max)

    def whole(v):
        big = F.greatest(F.least(v * scale, F.lit(most)), F.lit(-most))
        # doubles from 2^53 on are whole, and beyond 2^63 no long holds them
        return F.when(F.abs(big) >= float(1 << 53), big).otherwise(F.floor(big).cast("double"))

    return df.where(F.coalesce(ok, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("vec")).distinct()


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = 1 << 14, query_rows: int = 1 << 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``vectors``: vec_id, vec (whole numbers);
    ``is_query``: a Column."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    held = scratch.stage(vectors, "top_k_vectors")
    shards = -(-max(held.count(), 1) // shard_rows)
    parts = -(-spark.sparkContext.defaultParallelism // shards)
    c = held.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
    asked = c.where(is_query)
    first = scratch.stage(_meet(c, asked.withColumn("kth", F.lit(None).cast("string")), k, query_rows, shards, parts), "top_k_home")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("string").alias("kth"))
    # a query that found nothing at home keeps a null bound
    there = (asked.withColumnRenamed("shard", "home").join(kth, "vec_id", "left")
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home"))
    rest = _meet(c, there, k, query_rows, shards, parts)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = first.union(rest).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: All pairs of queries and candidates in DuckDB SQL.
TOP_K_SQL = """
WITH v AS (SELECT DISTINCT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
