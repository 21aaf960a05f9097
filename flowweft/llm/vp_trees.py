"""Nearest neighbours by vantage-point trees, one per shard of the table.

A tree node holds a vantage point and the distances at which its inner and outer half lie from it. A subtree is left
out when, by the triangle inequality, none of its points can be nearer than the k-th best so far; ``factor`` scales
that best distance in the test: 1 searches exactly, less leaves out more. Distances are chords between unit vectors,
which order as cosines do and obey the inequality. Queries go down a tree in blocks, as matrix products.

Of equal vectors only the k + 1 smallest ids are indexed: one can be the query itself, and the other k come before
all further copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..runtime import materialize
from .vectors import unit_rows, usable

FOUND = "query_id long, vec_id long, score double"
_ROUNDING = 1e-9


class Tree:
    """Vantage-point tree over unit vectors with leaves of about ``leaf`` points."""

    def __init__(self, x: np.ndarray, leaf: int = 256, seed: int = 1):
        self.x, self.leaf, self.rng = x, leaf, np.random.default_rng(seed)
        self.order = np.arange(len(x))
        self.root = self._build(0, len(x))

    def _build(self, a: int, b: int):
        if b - a <= self.leaf:
            return a, b, None
        here = self.order[a:b]
        point = self.x[here[self.rng.integers(b - a)]]
        away = chords(self.x[here] @ point)
        half = (b - a) // 2
        cut = np.argpartition(away, half)
        self.order[a:b] = here[cut]
        inner, outer = away[cut[:half]], away[cut[half:]]
        limits = inner.max(), outer.min()  # halves of equal size, also where many distances are equal
        return a, b, (point, *limits, self._build(a, a + half), self._build(a + half, b))

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, own: np.ndarray | None = None, ids: np.ndarray | None = None):
        """(query, point) index pairs: for each query all points that may be among its k nearest.

        ``own`` and ``ids`` exclude a query's own point. Points as near as the k-th, up to rounding, are all returned.
        """
        best = np.full((len(q), k), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node, who):
            if not len(who):
                return
            a, b, inside = node
            if inside is None:
                at = self.order[a:b]
                score = q[who] @ self.x[at].T
                if own is not None:
                    score[own[who][:, None] == ids[at][None]] = -np.inf
                top = np.concatenate([best[who], score], axis=1)
                best[who] = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
                r, c = np.nonzero((score >= best[who].min(axis=1, keepdims=True) - _ROUNDING) & np.isfinite(score))
                kept.append((who[r], at[c], score[r, c]))
                return
            point, inner_most, outer_least, inner, outer = inside
            away = chords(q[who] @ point)
            near_inner = away < (inner_most + outer_least) / 2

            def wanted(side, among, d):
                reach = factor * chords(best[among].min(axis=1)) + _ROUNDING
                return among[d - inner_most <= reach] if side is inner else among[outer_least - d <= reach]

            for first, second, part in ((inner, outer, near_inner), (outer, inner, ~near_inner)):
                group, d = who[part], away[part]
                visit(first, wanted(first, group, d))
                visit(second, wanted(second, group, d))

        visit(self.root, np.arange(len(q)))
        if not kept:
            return np.zeros(0, int), np.zeros(0, int)
        r, c, s = (np.concatenate(x) for x in zip(*kept, strict=True))
        good = s >= best.min(axis=1)[r] - _ROUNDING
        return r[good], c[good]


def chords(cosines: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(cosines, -1.0)))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine per row, summed in the same order for every pair: equal vectors give equal scores."""
    size = lambda v: np.sqrt((v * v).sum(axis=1))
    return np.clip((x * y).sum(axis=1) / (size(x) * size(y)), -1.0, 1.0)


def search_shard(k: int, factor: float, leaf: int):
    """The k nearest of one block of queries among the points of one shard."""

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})
        if not len(points) or not len(queries):
            return empty
        ids, own = points.vec_id.to_numpy(), queries.vec_id.to_numpy()
        tree = Tree(unit_rows(points["v"]), leaf)
        r, c = tree.search(unit_rows(queries["v"]), k, factor, own, ids)
        x, y = np.stack(queries["v"].to_numpy()), np.stack(points["v"].to_numpy())
        score = np.concatenate([_cosines(x[r[i:i + 50_000]], y[c[i:i + 50_000]]) for i in range(0, max(1, len(r)), 50_000)])
        best = np.lexsort((ids[c], -score, r))
        r, c, score = r[best], c[best], score[best]
        first = np.searchsorted(r, np.arange(len(own)))
        top = np.arange(len(r)) - first[r] < k
        return pd.DataFrame({"query_id": own[r[top]], "vec_id": ids[c[top]], "score": score[top]})

    return search


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0, shard_rows: int = 16_384,
    query_rows: int = 2_048, leaf: int = 512,
) -> DataFrame:
    """The ``k`` nearest rows by cosine for each row whose id is divisible by ``every``.

    Rows: query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller id, all candidates if there are
    fewer. Rows without an id and null, zero or non-finite vectors take no part; candidates of a query are vectors of its
    length. A repeated row is searched for once and found once, as its id is the same. An empty table gives no rows.
    Other columns are not read.
    """
    rows = materialize(usable(vectors).distinct())
    ranked = number_rows(rows.withColumn("_key", F.xxhash64("v")), ["_key", "v"], [F.col("vec_id")], "_copy")
    index = materialize(ranked.filter(F.col("_copy") <= k + 1).select("vec_id", "v", "w"))
    queries = materialize(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "w"))
    parts = lambda size, name: F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name)
    cut = materialize(  # a row per length that is asked for
        index.groupBy("w").agg(parts(shard_rows, "shards")).join(queries.groupBy("w").agg(parts(query_rows, "blocks")), "w")
    )
    spread = lambda n: F.pmod(F.xxhash64("vec_id", F.col(n)), F.col(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = index.join(cut, "w").withColumn("shard", spread("shards")).withColumn("block", to_all("blocks"))
    asks = queries.join(cut, "w").withColumn("block", spread("blocks")).withColumn("shard", to_all("shards"))
    at, columns = ["w", "shard", "block"], ["w", "shard", "block", "vec_id", "v"]
    found = points.select(*columns).groupBy(*at).cogroup(asks.select(*columns).groupBy(*at)).applyInPandas(
        search_shard(k, factor, leaf), FOUND
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a shard
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
