"""Hard negatives by scores bounded along a spanning tree of anchors.

A task holds a shard of candidates and a block of anchors. The block's anchors
form a minimum spanning tree. At the root every candidate is scored; at a child
the score of a candidate differs from its score at the parent by at most the
edge's length times the candidate's norm. So each child starts from intervals,
and only candidates whose interval reaches into a wanted window are scored anew;
the others pass their wider interval on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.llm.common import written
from threadgauge.llm.whitening import finite, scaled

SHARD = 8192
BLOCK = 512
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
_SLACK = 1e-9

Wanted = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def spanning_tree(points: np.ndarray) -> list[tuple[int, int]]:
    """(parent, child) edges of a minimum spanning tree from row 0, each after its parent's own edge."""
    parent, left = np.zeros(len(points), dtype=np.int64), np.ones(len(points), dtype=bool)
    near = np.full(len(points), np.inf)
    at, edges = 0, []
    left[0] = False
    for _ in range(len(points) - 1):
        gap = points - points[at]
        away = np.einsum("ij,ij->i", gap, gap)
        closer = away < near
        near[closer], parent[closer] = away[closer], at
        at = int(np.argmin(np.where(left, near, np.inf))) if np.isfinite(near[left]).any() else int(np.flatnonzero(left)[0])
        left[at] = False
        edges.append((int(parent[at]), at))
    return edges


class Scorer:
    """Inner products of a block of anchors with a shard of candidates, exact where they are wanted."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        size = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
        rough_a, rough_c = anchors.astype(np.float64), candidates.astype(np.float64)
        self.norms, self.lengths = size(rough_c), size(rough_a)
        exact = float(self.lengths.max(initial=0) * self.norms.max(initial=0)) < 2.0**52
        # Products of doubles are exact integers below 2**53; beyond that Python integers are.
        self.anchors = rough_a if exact else anchors.astype(object)
        self.candidates = rough_c if exact else candidates.astype(object)
        self.rough = rough_a
        self.scored = 0

    def run(self, wanted: Wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores) with the exact scores of the rows ``wanted`` asks for, given lower and upper bounds."""
        children: dict[int, list[int]] = {}
        for parent, child in spanning_tree(self.rough):
            children.setdefault(parent, []).append(child)
        known = np.asarray(self.candidates @ self.anchors[0]).astype(np.float64)
        self.scored += len(known)
        everything = np.arange(len(known))
        yield 0, everything[wanted(0, known, known)], self._exact(0, everything[wanted(0, known, known)])
        waiting = [(child, 0, known, known) for child in children.get(0, [])]
        while waiting:
            at, parent, low, high = waiting.pop()
            edge = np.linalg.norm(self.rough[at] - self.rough[parent])
            reach = self.norms * edge
            reach = reach + _SLACK * (reach + np.maximum(np.abs(low), np.abs(high))) + 1e-6
            most = self.norms * self.lengths[at] * (1 + _SLACK) + 1e-6
            low, high = np.maximum(low - reach, -most), np.minimum(high + reach, most)
            rows = np.flatnonzero(wanted(at, low, high))
            scores = self._exact(at, rows)
            self.scored += len(rows)
            low[rows] = high[rows] = scores.astype(np.float64)
            yield at, rows, scores
            waiting.extend((child, at, low, high) for child in children.get(at, []))

    def _exact(self, at: int, rows: np.ndarray) -> np.ndarray:
        some = self.candidates if len(rows) == len(self.candidates) else self.candidates[rows]
        return np.asarray(some @ self.anchors[at])


def _at_most(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k largest: whose upper bound reaches the k-th largest lower bound."""
    if len(low) <= k:
        return np.ones(len(low), dtype=bool)
    return high >= np.partition(low, len(low) - k)[len(low) - k]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    places = np.flatnonzero(_at_most(scores, scores, k))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int64)


def _positives(points: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best other rows of a shard for each anchor; all are of one label."""
    none = {"anchor_id": "int64", "positive_id": "int64", "positive_score": "int64"}
    out: list[tuple[int, int, int]] = []
    if len(points) and len(anchors):
        ids, own = points["vec_id"].to_numpy(np.int64), anchors["anchor_id"].to_numpy(np.int64)

        def wanted(at: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            rows = np.flatnonzero(ids != own[at])
            mask = np.zeros(len(ids), dtype=bool)
            mask[rows] = _at_most(low[rows], high[rows], k)
            return mask

        for at, rows, scores in Scorer(_matrix(anchors["anchor_x"]), _matrix(points["x"])).run(wanted):
            for place in _first(scores, ids[rows], k):
                out.append((own[at], ids[rows[place]], int(scores[place])))
    return pd.DataFrame(out, columns=list(none)).astype(none)


def _negatives(points: pd.DataFrame, anchors: pd.DataFrame, k: int, low_part: int, high_part: int) -> pd.DataFrame:
    """The k best rows of a shard of another label in the window of each positive of each anchor."""
    none = {"anchor_id": "int64", "positive_id": "int64", "negative_id": "int64", "positive_score": "int64", "negative_score": "int64"}
    out: list[tuple[int, int, int, int, int]] = []
    if len(points) and len(anchors):
        ids, labels = points["vec_id"].to_numpy(np.int64), points["label"].to_numpy()
        own, label = anchors["anchor_id"].to_numpy(np.int64), anchors["anchor_label"].to_numpy()
        windows = [
            [(int(i), int(s), -(-low_part * int(s) // 100), high_part * int(s) // 100) for i, s in zip(ps, ss, strict=True)]
            for ps, ss in zip(anchors["positive_ids"], anchors["positive_scores"], strict=True)
        ]

        def wanted(at: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            other = labels != label[at]
            mask = np.zeros(len(ids), dtype=bool)
            for _, _, least, most in windows[at]:
                rows = np.flatnonzero(other & (high >= least) & (low <= most))
                inside = rows[(low[rows] >= least) & (high[rows] <= most)]
                bar = np.partition(low[inside], len(inside) - k)[len(inside) - k] if len(inside) >= k else -np.inf
                mask[rows[high[rows] >= bar]] = True
            return mask

        for at, rows, scores in Scorer(_matrix(anchors["anchor_x"]), _matrix(points["x"])).run(wanted):
            for positive, score, least, most in windows[at]:
                fits = np.flatnonzero((scores >= least) & (scores <= most))
                for place in _first(scores[fits], ids[rows[fits]], k):
                    out.append((own[at], positive, ids[rows[fits[place]]], score, int(scores[fits[place]])))
    return pd.DataFrame(out, columns=list(none)).astype(none)


def _dealt(sizes: DataFrame, keys: list[str], shard: int, block: int) -> DataFrame:
    return sizes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"), F.ceil(F.count_if("a") / block).alias("blocks")).filter("blocks > 0")


def _spread(points: DataFrame, anchors: DataFrame, counts: DataFrame, keys: list[str], extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points in shards, once per block of anchors; anchors in blocks, once per shard."""
    shard, block = F.pmod(F.xxhash64("vec_id"), "shards").alias("s"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), "blocks").alias("b")
    left = points.join(counts, keys).select(*keys, shard, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "vec_id", "label", "x")
    right = anchors.join(counts, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"), block, "vec_id", "label", "x", *extra)
    names = {"vec_id": "anchor_id", "label": "anchor_label", "x": "anchor_x"}
    return left, right.select(*[F.col(c).alias(f"in_{c}") for c in [*keys, "s", "b"]], *[F.col(c).alias(names.get(c, c)) for c in ["vec_id", "label", "x", *extra]])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, shard: int = SHARD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor row.

    Scores are integer inner products of floor(256 * component). An anchor's
    positives are its best other rows of its label; a positive's negatives are the
    best rows of another label that score between ``low`` and ``high`` percent of
    it. Ties go to the smaller id. Rows with a null id or label, or a null, empty
    or non-finite vector take no part; of rows with one id the smallest (label,
    vector) stands and is an anchor if one of them is. Rows of different lengths
    have no score with one another. A window below zero is empty, so positives
    with a negative score have no negatives. Scores must fit a long. Other columns
    are ignored; no rows or no anchors give no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("a"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")) & (F.size("v") > 0))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", scaled(F.col("v")).alias("x"))).alias("r"), F.max("a").alias("a"))
    rows = written(rows.select("vec_id", "r.label", "r.x", F.size("r.x").alias("d"), "a"), "vectors")
    anchors = rows.filter("a")
    points, asked = _spread(rows, anchors, _dealt(rows, ["d", "label"], shard, block), ["d", "label"], [])
    found = points.groupBy("d", "label", "s", "b").cogroup(asked.groupBy("in_d", "in_label", "in_s", "in_b")).applyInPandas(
        partial(_positives, k=positives), "anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= positives) & (F.col("positive_score") >= 0))
    best = best.groupBy("anchor_id").agg(F.collect_list("positive_id").alias("positive_ids"), F.collect_list("positive_score").alias("positive_scores"))
    windows = written(anchors.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "windows")
    points, asked = _spread(rows, windows, _dealt(rows, ["d"], shard, block), ["d"], ["positive_ids", "positive_scores"])
    found = points.groupBy("d", "s", "b").cogroup(asked.groupBy("in_d", "in_s", "in_b")).applyInPandas(
        partial(_negatives, k=negatives, low_part=low, high_part=high),
        "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
