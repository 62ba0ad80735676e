"""Exact top-k by inner product: a KD-tree a shard, searched best first by bounds of its boxes."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, Block, search, usable

LEAF, SCALE = 128, 256
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
#: Scores beyond a long count as the nearest long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class KdTree:
    """Median splits along the widest side, with tight boxes. children[i] is 0 for a leaf."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.spans, self.children = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            node, here = len(self.spans), points[order[a:b]]
            if parent >= 0:
                self.children[parent] = (*self.children[parent], node)
            low, high = here.min(0), here.max(0)
            self.low.append(low)
            self.high.append(high)
            self.spans.append((a, b))
            self.children.append(())
            side = int(np.argmax(high - low))
            if b - a > LEAF and high[side] > low[side]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(here[:, side], middle)]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that any point of each box can reach, for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def best(self, query: np.ndarray, own: int, reach: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best: visits boxes from the most promising on, until none can reach the k-th best score, `bound` at first."""
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        heap = [(-reach[0], 0)]
        while heap and -heap[0][0] >= bound:
            node = heapq.heappop(heap)[1]
            if self.children[node]:
                for child in self.children[node]:
                    if reach[child] >= bound:
                        heapq.heappush(heap, (-reach[child], child))
                continue
            a, b = self.spans[node]
            reached = self.points[a:b] @ query
            some = (reached >= bound) & (self.ids[a:b] != own)
            if some.any():
                scores, ids = np.concatenate([scores, reached[some].astype(np.int64)]), np.concatenate([ids, self.ids[a:b][some]])
                if len(ids) >= k:
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                    bound = max(bound, int(scores[-1]))
        return scores, ids


def whole_number(x: float) -> int:
    return math.floor(SCALE * x) if abs(x) < EXACT else SCALE * int(x)


def wide(matrix: np.ndarray) -> np.ndarray:
    """Rows with components so large that products of two such may not be exact in doubles."""
    return np.abs(matrix).max(1, initial=0.0) >= math.sqrt(EXACT / max(1, matrix.shape[1])) / SCALE - 1


def first_bounds(probe: Block, queries: Block, k: int) -> np.ndarray:
    """Each query's k-th best score among the probe's narrow rows, which no final k-th best is below; none for wide queries."""
    least = np.full(len(queries[0]), LEAST, np.int64)
    narrow, rows = np.flatnonzero(~wide(queries[1])), ~wide(probe[1])
    if rows.sum() > k and len(narrow):
        scores = np.floor(SCALE * queries[1][narrow]) @ np.floor(SCALE * probe[1][rows]).T
        scores[queries[0][narrow][:, None] == probe[0][rows]] = -EXACT
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        least[narrow] = np.where(kth > -EXACT, kth, LEAST)
    return least


def visit(shard: Block, queries: Block, best: Best) -> None:
    """Searches one shard: narrow queries its tree of narrow rows, and what is wide in Python's whole numbers."""
    ids, points = shard
    wide_rows, wide_queries = wide(points), wide(queries[1])
    narrow = np.flatnonzero(~wide_queries)
    found = []
    if len(narrow) and not wide_rows.all():
        tree = KdTree(ids[~wide_rows], np.floor(SCALE * points[~wide_rows]))
        asked = np.floor(SCALE * queries[1][narrow])
        for q, query, reach in zip(narrow.tolist(), asked, tree.bounds(asked), strict=True):
            scores, near = tree.best(query, int(queries[0][q]), reach, best.k, int(best.bounds[q]))
            found.append((np.full(len(near), q), scores, near))
        best.add(*map(np.concatenate, zip(*found, strict=True)))

    whole = [[whole_number(x) for x in p] for p in points[wide_rows].tolist()]
    if wide_queries.any():
        others = [[whole_number(x) for x in p] for p in points[~wide_rows].tolist()]
    for q in range(len(wide_queries)) if len(whole) else np.flatnonzero(wide_queries).tolist():
        query = [whole_number(x) for x in queries[1][q].tolist()]
        for kept, rows in ((wide_rows, whole), (~wide_rows, others if wide_queries[q] else [])):
            scores = np.array([max(LEAST, min(MOST, sum(map(int.__mul__, query, p)))) for p in rows], np.int64)
            these = ids[kept] if len(rows) else np.empty(0, np.int64)
            apart = these != queries[0][q]
            best.add(np.full(apart.sum(), q), scores[apart], these[apart])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(256 x), ties to smaller ids.

    Every row of vectors (vec_id, embedding) is a candidate but those with the query's own id.
    Rows with a null id, and vectors that are null, empty or hold null or non-finite
    components, take no part; vectors of different lengths don't meet. A repeated query id is
    one query, with its smallest vector; repeated candidates are candidates each. Fewer than k
    candidates give fewer rows, no queries none. Scores are exact whatever the components; one
    beyond a long counts as the nearest long. Other columns don't matter.
    """
    ok = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    of = lambda df: df.where(ok).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return search(of(vectors), of(queries), k, "long", lambda matrix: matrix, first_bounds, visit, sure=True)
