"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt by hash into shards of bounded size. A shard's tree splits its
points at the median distance from a vantage point. A block of queries goes down
the tree together: nearer side first, then the other side for those queries that
the triangle inequality cannot rule out. The bound is multiplied by a factor:
one is exact search, a larger one prunes more. What is found is ranked by the
distance on the original vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.llm.common import written

SHARD = 8192
QUERIES = 4096
LEAF = 256
FACTOR = 4.0


@dataclass
class Node:
    """A leaf holds ``rows``; an inner node a vantage point with the outermost distance inside and the innermost outside."""

    rows: np.ndarray | None = None
    vantage: int = -1
    inner_most: float = 0.0
    outer_least: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a to the same row of b, by differences."""
    gap = a - b
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, up to rounding; only used to leave rows out."""
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)


def build(points: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> Node:
    """A tree over ``rows`` of ``points``. Halves are cut by rank, so equal distances still split; depth is logarithmic."""
    if len(rows) <= leaf:
        return Node(rows=rows)
    vantage = int(rows[rng.integers(len(rows))])
    away = exact(points[rows], points[vantage])
    order = np.argsort(away, kind="stable")
    half = len(rows) // 2
    away, rows = away[order], rows[order]
    return Node(
        None, vantage, float(away[half - 1]), float(away[half]),
        build(points, rows[:half], leaf, rng), build(points, rows[half:], leaf, rng),
    )


class Search:
    """k nearest rows of ``points`` for a block of queries; ``own`` is each query's row id, which is no answer."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.points, self.ids, self.queries, self.own, self.k, self.factor = points, ids, queries, own, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), -1, dtype=np.int64)
        self.compared = 0

    def run(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.rows is not None:
            self._leaf(node.rows, active)
            return
        away = exact(self.queries[active], self.points[node.vantage])
        self.compared += len(active)
        inside = away - node.inner_most < node.outer_least - away
        self.run(node.inner, active[inside])
        self.run(node.outer, active[~inside])
        reach = self.best[active, -1]
        again = (away - node.inner_most) * self.factor <= reach
        self.run(node.inner, active[~inside & again])
        again = (node.outer_least - away) * self.factor <= reach
        self.run(node.outer, active[inside & again])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.compared += len(active) * len(rows)
        queries, points, ids = self.queries[active], self.points[rows], self.ids[rows]
        about = rough(queries, points)
        about[ids == self.own[active][:, None]] = np.inf
        limit = self.best[active, -1] ** 2
        if len(rows) > self.k:
            limit = np.minimum(limit, np.partition(about, self.k - 1, axis=1)[:, self.k - 1])
        scale = np.einsum("ij,ij->i", queries, queries) + np.einsum("ij,ij->i", points, points).max()
        q, p = np.nonzero((about <= (limit + 1e-9 * scale)[:, None]) & np.isfinite(about))
        if not len(q):
            return
        away = exact(queries[q], points[p])
        owner = np.concatenate([np.repeat(np.arange(len(active)), self.k), q])
        both = np.concatenate([self.best[active].ravel(), away])
        names = np.concatenate([self.found[active].ravel(), ids[p]])
        order = np.lexsort((names, both, owner))
        first = np.searchsorted(owner[order], np.arange(len(active)))
        taken = order[first[:, None] + np.arange(self.k)[None, :]]
        self.best[active], self.found[active] = both[taken], names[taken]


def _search(points: pd.DataFrame, queries: pd.DataFrame, k: int, factor: float, leaf: int) -> pd.DataFrame:
    if not len(points) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    data = np.stack(points["v"].to_numpy()).astype(np.float64)
    wanted = np.stack(queries["query_v"].to_numpy()).astype(np.float64)
    ids, own = points["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    search = Search(data, ids, wanted, own, k, factor)
    search.run(build(data, np.arange(len(ids)), leaf, np.random.default_rng(len(ids))), np.arange(len(own)))
    there = np.isfinite(search.best)
    return pd.DataFrame({"query_id": np.repeat(own, k)[there.ravel()], "vec_id": search.found[there], "score": search.best[there]})


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, factor: float = FACTOR, shard: int = SHARD, block: int = QUERIES, leaf: int = LEAF,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other rows, ties to the smaller id.

    Candidates are the usable vectors with as many components as the query. Null
    ids take no part and of repeated ids the smallest vector stands for the id.
    Every row is indexed; shards have about ``shard`` rows and blocks about
    ``block`` queries, so a task's memory does not grow with the input. A query
    with fewer candidates gets them all; other columns are ignored; no rows give
    no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = written(rows.withColumn("d", F.size("v")), "vectors")
    shards = rows.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"), F.ceil(F.count_if("q") / block).alias("blocks"))
    dealt = rows.join(F.broadcast(shards), "d") if shards.count() <= 1024 else rows.join(shards, "d")
    points = dealt.filter("blocks > 0").select(
        "d", F.pmod(F.xxhash64("vec_id"), "shards").alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "vec_id", "v"
    )
    queries = dealt.filter("q").select(
        "d", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), "blocks").alias("b"), "vec_id", "v"
    ).toDF("query_d", "query_s", "query_b", "query_id", "query_v")
    found = points.groupBy("d", "s", "b").cogroup(queries.groupBy("query_d", "query_s", "query_b")).applyInPandas(
        partial(_search, k=k, factor=factor, leaf=leaf), "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
