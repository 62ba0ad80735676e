"""What the vector searches share: query blocks against all shards of a table of vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, session, shared_dir

#: Bytes of queries broadcast at a time, as doubles. Further blocks take further passes.
QUERY_BYTES = 32 << 20
#: Rows that set the first bounds of a block's queries; any rows do, they only save work.
PROBE = 2048
#: Vectors a shard holds.
SHARD = 1 << 14

#: Vectors of one length: their ids and a matrix of doubles.
Block = tuple[np.ndarray, np.ndarray]


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def by_length(ids: np.ndarray, vectors: pa.Array) -> dict[int, Block]:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = ids[rows], flat[(ends[rows] - n)[:, None] + np.arange(n)]
    return out


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """The partition's vectors, SHARD of one length at a time."""
    held: dict[int, list[Block]] = {}
    for batch in batches:
        for n, block in by_length(batch.column(0).to_numpy(), batch.column(1)).items():
            held.setdefault(n, []).append(block)
            if sum(len(i) for i, _ in held[n]) >= SHARD:
                yield n, tuple(map(np.concatenate, zip(*held.pop(n), strict=True)))
    for n, blocks in held.items():
        yield n, tuple(map(np.concatenate, zip(*blocks, strict=True)))


class Best:
    """For each query its k best (score, id) so far: higher scores, then smaller ids.

    first: scores that the k-th best of all rows reaches. bounds: scores below a query's bound
    can't be among its k best; at first `first` if a search is sure to find all that reach it.
    """

    def __init__(self, k: int, first: np.ndarray, sure: bool = True):
        self.k, self.first = k, first
        self.bounds = first.copy() if sure else np.full(len(first), -np.inf)
        self.at, self.scores, self.ids = np.empty(0, np.int64), np.empty(0, first.dtype), np.empty(0, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in scores[i] of row ids[i] for the query at[i]; a row comes once."""
        some = scores >= self.bounds[at]
        if not some.any():
            return
        at, scores, ids = (np.concatenate([x, y[some]]) for x, y in ((self.at, at), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == self.k - 1
        self.bounds[at[last]] = np.maximum(self.bounds[at[last]], scores[last])
        top = place < self.k
        self.at, self.scores, self.ids = at[top], scores[top], ids[top]

    def rows(self, of: np.ndarray) -> pa.RecordBatch:
        columns = [of[self.at], self.ids, self.scores]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    score_type: str,
    prepare: Callable[[np.ndarray], np.ndarray],
    bounds: Callable[[Block, Block, int], np.ndarray],
    visit: Callable[[Block, Block, Best], Any],
    sure: bool,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each query, by id but its own.

    Both tables are (vec_id, embedding) with usable vectors. prepare makes of a matrix of
    vectors the one to search; bounds gives scores that the k-th best surely reaches, from a
    few rows; visit(shard's ids and matrix, queries, best) searches one shard, and is sure to find
    what reaches the bounds or not. The queries are written once. Each pass broadcasts one block of them, QUERY_BYTES at most, reads all
    vectors once and builds each shard's index once; only the k best of each query and task
    are shuffled.
    """
    spark = session(vectors.sparkSession)
    queries = cut(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    numbers = queries.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()[0]
    blocks = -(-8 * numbers // QUERY_BYTES)
    probe = by_length(*_collected(vectors.limit(PROBE)))
    path = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    schema = f"query_id long, vec_id long, score {score_type}"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        block = by_length(*_collected(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)))
        asked = {}
        for n, (ids, matrix) in block.items():
            made = prepare(matrix)
            known = probe.get(n, (np.empty(0, np.int64), np.empty((0, n))))
            asked[n] = ids, made, bounds((known[0], prepare(known[1])), (ids, made), k)
        shipped = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shipped: Any = shipped) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            for n, (ids, matrix) in shards(batches):
                if n in shipped.value:
                    asked_ids, made, least = shipped.value[n]
                    found = best.setdefault(n, Best(k, least, sure))
                    visit((ids, prepare(matrix)), (asked_ids, made), found)
            for n, found in best.items():
                yield found.rows(shipped.value[n][0])

        vectors.mapInArrow(run, schema).write.mode("append").parquet(path)
        shipped.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _collected(rows: DataFrame) -> tuple[np.ndarray, pa.Array]:
    """A block of queries or a probe; both are of bounded size."""
    found = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).toArrow()
    return found.column(0).to_numpy(), found.column(1).combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.float64()))
