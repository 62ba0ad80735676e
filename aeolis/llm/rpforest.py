"""Approximate nearest neighbours by cosine: a forest of random-projection trees a shard.

All trees of a shard share one priority queue. A branch's priority is the chance that a vector
as near to the query as its k-th best so far stands in it, judged by the planes above it; the
likeliest branch of any tree is opened next. The first leaves show how near neighbours are. A query is done with a shard when the chance that
such a vector stands in none of the leaves opened, in any tree, has fallen to MISS: near
neighbours end a search early, and how many leaves are opened follows the data, not the
shard's size. The leaves' vectors are scored leaf by leaf for all queries that opened them, and
what may be among the k best is reranked exactly.
"""

from __future__ import annotations

import heapq
import math
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, Block, search, usable

TREES, LEAF = 6, 192
#: Chance of a miss at which a query is done with a shard; recall follows it.
MISS = 0.07
#: Queries looked at together.
TOGETHER = 1024
#: Scores held before they are merged into the k best.
HELD = 1 << 18
#: The logistic function with this factor is near the normal distribution's.
LOGISTIC = 1.702


class Forest:
    """Trees over unit vectors. Nodes are numbered from 0, parents first; leaves -1, -2, ..."""

    def __init__(self, points: np.ndarray, seed: int = 1):
        self.points, self.random = points, np.random.default_rng(seed)
        self.normals, self.offsets, self.spreads, self.sides, self.leaves = [], [], [], [], []
        self.roots = [self.grow(np.arange(len(points))) for _ in range(TREES)]
        self.normals = np.array(self.normals).reshape(-1, points.shape[1])

    def grow(self, rows: np.ndarray) -> int:
        """The root of a tree over rows."""
        root = [0]
        todo = [(rows, root, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                parent[side] = -len(self.leaves)
            else:
                parent[side] = len(self.sides)
                normal, offset, spread, left = self.split(rows)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.spreads.append(spread)
                self.sides.append(children := [0, 0])
                todo += [(rows[left], children, 0), (rows[~left], children, 1)]
        return root[0]

    def split(self, rows: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
        """A plane midway between two random points; if it leaves one side nearly empty, the median along it."""
        a, b = self.points[self.random.choice(rows, 2, replace=False)]
        normal = a - b
        if not (size := np.linalg.norm(normal)):
            normal, size = self.random.standard_normal(len(a)), 1.0
        normal = normal / size
        along = self.points[rows] @ normal
        offset = float(normal @ (a + b) / 2)
        if not 0.1 < (along < offset).mean() < 0.9:
            offset = float(np.median(along))
        left = along < offset
        if not left.any() or left.all():
            left = np.arange(len(rows)) % 2 == 0
        return normal, offset, max(float(along.std()), 1e-9), left

    def chances(self, queries: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the chance of each node and leaf to hold a vector of cosine `near` to the query.

        Along a plane's normal such a vector stands at near times the query's place, give or
        take sqrt(1 - near^2) of the spread that vectors have there.
        """
        nodes, leaves = np.zeros((len(self.sides), len(queries))), np.zeros((len(self.leaves), len(queries)))
        at = self.normals @ (queries * near[:, None]).T
        wide = np.sqrt(1 - near * near)
        for node, (left, right) in enumerate(self.sides):
            z = LOGISTIC * (at[node] - self.offsets[node]) / (wide * self.spreads[node])
            for child, way in ((left, z), (right, -z)):
                of, number = (nodes, child) if child >= 0 else (leaves, -1 - child)
                of[number] = nodes[node] - np.logaddexp(0, way)
        return nodes.T, leaves.T

    def open(self, nodes: list[float], leaves: list[float], most: float = math.inf) -> list[int]:
        """The leaves to look into, the likeliest first and `most` at most, for a query with these chances."""
        heap = [(0.0, tree, root) for tree, root in enumerate(self.roots)]
        missed, opened = [1.0] * len(heap), []
        while heap and len(opened) < most:
            chance, tree, node = heapq.heappop(heap)
            if node >= 0:
                for child in self.sides[node]:
                    heapq.heappush(heap, (-(nodes[child] if child >= 0 else leaves[-1 - child]), tree, child))
            else:
                opened.append(-1 - node)
                missed[tree] = max(0.0, missed[tree] - math.exp(-chance))
                if math.prod(missed) <= MISS:
                    break
        return opened


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two near their largest component, so that no square over- or underflows; cosines stay the same."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(1, initial=0.0))[1][:, None])


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, of scaled vectors."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def first_bounds(probe: Block, queries: Block, k: int) -> np.ndarray:
    """Each query's k-th best cosine among the probe, a little less for rounding."""
    least = np.full(len(queries[0]), -np.inf)
    if len(probe[0]) > k:
        scores = unit(queries[1]) @ unit(probe[1]).T
        scores[queries[0][:, None] == probe[0]] = -np.inf
        least = np.partition(scores, len(probe[0]) - k, axis=1)[:, len(probe[0]) - k] - 1e-9
    return least


def visit(shard: Block, queries: Block, best: Best) -> None:
    """Searches one shard. Of equal vectors, the k with the smallest ids but the query's own stand for all."""
    order = np.argsort(shard[0], kind="stable")
    ids, points = shard[0][order], shard[1][order]
    _, first, member = np.unique(np.ascontiguousarray(points).view(f"V{points.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    by_member = np.argsort(member, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(member))]
    different = np.unique(ids)
    places = np.sort(member * len(different) + np.searchsorted(different, ids))  # of every row: its vector, then its id
    points = points[first]
    forest = Forest(unit(points))
    asked = unit(queries[1])

    merged = np.empty(0, np.int64)

    def merge(at: np.ndarray, groups: np.ndarray) -> None:
        nonlocal merged
        new = np.setdiff1d(at * len(points) + groups, merged)  # a row comes once, whatever trees lead to it
        merged = np.union1d(merged, new)
        at, groups = np.divmod(new, len(points))
        scores = cosines(points[groups], queries[1][at])
        own = np.minimum(np.searchsorted(different, queries[0][at]), len(different) - 1)
        own_place = groups * len(different) + own
        own_rows = np.searchsorted(places, own_place, "right") - np.searchsorted(places, own_place)  # they stand together
        n = np.minimum(starts[groups + 1] - starts[groups], best.k + own_rows)
        at, scores = np.repeat(at, n), np.repeat(scores, n)
        own_ids = ids[by_member[np.repeat(starts[groups], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        others = own_ids != queries[0][at]
        best.add(at[others], scores[others], own_ids[others])

    def score(at: np.ndarray, leaf: np.ndarray) -> None:
        """Looks into leaf[i] for the query at[i]: one product for each leaf."""
        order = np.argsort(leaf, kind="stable")
        leaf, at = leaf[order], at[order]
        edges, held, found = [*np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf)], 0, []
        for i, j in pairwise(edges):
            rows, own = forest.leaves[leaf[i]], at[i:j]
            hit, row = np.nonzero(asked[own] @ forest.points[rows].T >= best.bounds[own][:, None] - 1e-9)
            found.append((own[hit], rows[row]))
            held += len(hit)
            if held >= HELD or j == len(leaf):
                merge(*map(np.concatenate, zip(*found, strict=True)))
                held, found = 0, []

    for a in range(0, len(asked), TOGETHER):
        merged = np.empty(0, np.int64)
        some = slice(a, a + TOGETHER)
        for most in (1, TREES, math.inf):  # the likeliest leaves set bounds and show how near neighbours are
            near = np.clip(np.maximum(best.first, best.bounds)[some], 0, 0.9999)
            chances = zip(*forest.chances(asked[some], near), strict=True)
            opened = [forest.open(n.tolist(), leaf.tolist(), most) for n, leaf in chances]
            score(a + np.repeat(np.arange(len(opened)), list(map(len, opened))), np.concatenate(opened))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): k near rows by cosine, nearest first, ties to smaller ids.

    Scores are the cosines of the original vectors in double precision, whatever their length.
    Every row of vectors (vec_id, embedding) is indexed, and is a candidate but for those with
    the query's own id. Rows with a null id, and vectors that are null, empty, zero or hold null
    or non-finite components, take no part; vectors of different lengths don't meet. A repeated
    query id is one query, with its smallest vector; repeated candidates are candidates each.
    Fewer than k candidates give fewer rows, no queries or no rows give none. Other columns
    don't matter.
    """
    some = F.exists("embedding", lambda x: x != 0)
    ok = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & some
    of = lambda df: df.where(ok).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return search(of(vectors), of(queries), k, "double", scaled, first_bounds, visit, sure=False)
