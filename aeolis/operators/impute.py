"""Filling gaps from the past alone."""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import slices
from .features import in_order


def ffill(df: DataFrame, cols: Sequence[str], limit: int = 6, order: Sequence[str] = ("Datetime",), by: str | Sequence[str] = "station_id") -> DataFrame:
    """The last value of the `limit` rows before."""
    w = in_order(by, order).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fill_past_mean(df: DataFrame, cols: Sequence[str], width: int = 24, order: Sequence[str] = ("Datetime",), by: str | Sequence[str] = "station_id") -> DataFrame:
    """The mean of the `width` rows before."""
    w = in_order(by, order).rowsBetween(-width, -1)
    return df.withColumns({c: F.coalesce(c, F.avg(c).over(w)) for c in cols})


#: Rows of a station that one task takes for past medians.
BLOCK = 1 << 15


def fill_past_median(df: DataFrame, cols: Sequence[str], order: Sequence[str] = ("Datetime",), by: str = "station_id", block: int = BLOCK) -> DataFrame:
    """The median of all rows before; filled columns become doubles.

    Where no station has more than `block` rows, one sorted pass: the lower and the upper half of
    a station's values so far are two heaps, so a value costs the logarithm of their number.
    Otherwise stations are taken in blocks of rows (see _in_blocks). Rows without a station are a
    station of their own; NaN is no value, and isn't filled.
    """
    rows = df.withColumns({c: F.col(c).cast("double") for c in cols})
    if (rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0) <= block:
        return _one_pass(rows, cols, order, by)
    made = slices.number_rows(rows, order, by)
    for c in cols:
        made = _in_blocks(made, c, by, block)
    return made.select(*df.columns)


def _one_pass(rows: DataFrame, cols: Sequence[str], order: Sequence[str], by: str) -> DataFrame:
    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, halves = None, {}
        for batch in batches:
            stations, made = batch.column(by).to_pylist(), {}
            values = {c: batch.column(c).to_pylist() for c in cols}
            for i, station in enumerate(stations):
                if (station,) != at:
                    at, halves = (station,), {c: ([], []) for c in cols}
                for c, column in values.items():
                    x, (low, high) = column[i], halves[c]  # low: negated, its top is the middle or just below
                    if x is None:
                        if low:
                            column[i] = -low[0] if len(low) > len(high) else 0.5 * -low[0] + 0.5 * high[0]
                    elif x == x:
                        heapq.heappush(high, -heapq.heappushpop(low, -x))
                        if len(high) > len(low):
                            heapq.heappush(low, -heapq.heappop(high))
            for c, column in values.items():
                made[c] = pa.array(column, pa.float64())
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(filled, rows.schema)


class Past:
    """The values about the median of a growing set: how many are smaller, these in order, how many are in all."""

    def __init__(self):
        self.below, self.held, self.all, self.ends = 0, [], 0, None

    def add(self, x: float) -> None:
        if self.ends is None:  # what is held of the past is whole now
            more = self.all > self.below + len(self.held)
            self.ends = self.held[0] if self.below else -math.inf, self.held[-1] if more else math.inf
        self.all += 1
        if x < self.ends[0]:
            self.below += 1
        elif x <= self.ends[1]:
            bisect.insort(self.held, x)

    def median(self) -> float | None:
        if not self.all:
            return None
        low, high = (self.held[at - self.below] for at in ((self.all - 1) // 2, self.all // 2))
        return low if self.all % 2 else 0.5 * low + 0.5 * high


def _in_blocks(rows: DataFrame, c: str, by: str, block: int) -> DataFrame:
    """rows (with _rn) with c filled, `block` rows of a station in a task, each with a bounded part of its past.

    Within a block of R rows the median moves by at most R ranks of the values before the block,
    so a task needs only these: the values of ranks about the middle, and how many are smaller.
    Which they are follows from counts: values are numbered by size within their station and cut
    into buckets of R; counts by bucket and block are summed over the blocks before; and of a
    block's past only the buckets that hold the ranks in question are sent to it, about 4 R values.
    """
    keys = [by, "_block"]
    rows = rows.withColumn("_block", F.floor(F.col("_rn") / block))
    values = slices.number_rows(rows.where(F.col(c).isNotNull() & ~F.isnan(c)).select(by, "_block", "_rn", c), [c, "_rn"], by, name="_at")
    values = values.withColumn("_bucket", F.floor(F.col("_at") / block))

    def each(t: DataFrame, part: str, name: str) -> DataFrame:
        last = t.groupBy(by).agg(F.max(part).alias("_last"))
        return last.select(F.col(by).alias(f"_{name}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias(name))

    grid = each(rows, "_block", "b").join(each(values, "_bucket", "v"), F.col("_b").eqNullSafe(F.col("_v")))  # a station's blocks by its buckets
    counts = values.groupBy(by, "_block", "_bucket").agg(F.count("*").alias("_n"))
    grid = grid.join(counts, F.col("_b").eqNullSafe(F.col(by)) & (F.col("b") == F.col("_block")) & (F.col("v") == F.col("_bucket")), "left")
    earlier = Window.partitionBy("_b", "v").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("_b", "b", "v", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_past"))
    of_block = Window.partitionBy("_b", "b")
    grid = grid.withColumns({"_end": F.sum("_past").over(of_block.orderBy("v")), "_all": F.sum("_past").over(of_block)}).withColumn("_start", F.col("_end") - F.col("_past"))
    middle = F.floor((F.col("_all") - 1) / 2)
    near = grid.where((F.col("_past") > 0) & (F.col("_end") > middle - block) & (F.col("_start") <= middle + 1 + block))

    # what a block reads, in this order: how many values are smaller and how many there are, the past about the middle, its own rows
    known = near.groupBy("_b", "b").agg(F.min("_start").alias("s"), F.max("_all").alias("n"))
    known = known.select("_b", "b", F.inline(F.array(*(F.struct(F.lit(k).alias("_kind"), F.col(x).cast("double").alias(c)) for k, x in enumerate("sn")))))
    past = near.select("_b", "b", "v").join(values, F.col("_b").eqNullSafe(F.col(by)) & (F.col("v") == F.col("_bucket")) & (F.col("_block") < F.col("b")))
    named = lambda t: t.select(F.col("_b").alias(by), F.col("b").alias("_block"), "_kind", c)
    read = rows.withColumn("_kind", F.lit(3)).unionByName(named(known), True).unionByName(named(past.withColumn("_kind", F.lit(2))), True)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Past()
        for batch in batches:
            x = batch.column(c).to_pylist()
            for i, (kind, *key) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("_kind", *keys)), strict=True)):
                if key != at:
                    at, state = key, Past()
                if kind == 0:
                    state.below = int(x[i])
                elif kind == 1:
                    state.all = int(x[i])
                elif kind == 2:
                    state.held.append(x[i])
                elif x[i] is None:
                    x[i] = state.median()
                elif x[i] == x[i]:
                    state.add(x[i])
            made = [pa.array(x, pa.float64()) if n == c else batch.column(n) for n in batch.schema.names]
            own = pa.array([k == 3 for k in batch.column("_kind").to_pylist()])
            yield pa.RecordBatch.from_arrays(made, names=batch.schema.names).filter(own)

    dealt = read.repartition(*keys).sortWithinPartitions(*keys, "_kind", F.when(F.col("_kind") == 3, F.col("_rn")), c)
    return dealt.mapInArrow(filled, read.schema).drop("_kind", "_block")


def impute(df: DataFrame, cols: Sequence[str], limit: int = 6, width: int = 24, median: bool = True, order: Sequence[str] = ("Datetime",), by: str = "station_id") -> DataFrame:
    """All three in turn; ids, times and the target are untouched unless named."""
    df = fill_past_mean(ffill(df, cols, limit, order, by), cols, width, order, by)
    return fill_past_median(df, cols, order, by) if median else df
