"""Lookback/horizon windows: an index of plain window expressions, and tensors on demand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from . import slices

LOOKBACK, STRIDE, MIN_RATIO = 168, 3, 0.75


def window_index(
    df: DataFrame,
    y: str,
    cols: Sequence[str],
    lookback: int = LOOKBACK,
    horizons: Sequence[int] = (1,),
    stride: int = STRIDE,
    min_ratio: float = MIN_RATIO,
    order: Sequence[str] = ("Datetime",),
    by: str = "station_id",
    split: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """(station, [split,] horizon, start, target_time, y, valid_ratio): a row a window.

    Windows start at every stride-th row of a station (of a split) and hold `lookback` rows; y
    stands `horizon` rows behind the last. One without a finite y, or with a smaller share of
    finite cells than min_ratio (on the data as they are), is dropped. With `size` a station is
    cut into slices of so many rows (see slices), each with the rows that its windows reach ahead.
    """
    keys, there = [by, split] if split else [by], F.lit(True)
    w = Window.partitionBy(*keys).orderBy(*order)
    place, whole, df = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*keys)), df.select(*keys, *dict.fromkeys([*order, y, *cols]))
    if size:
        numbered = slices.number_rows(df.withColumn("_series", F.struct(*keys)), order, "_series", count="_n")
        df = slices.with_halo(numbered, 0, lookback - 1 + max(horizons), size)
        w, place, whole, there = Window.partitionBy("_series", "_slice").orderBy("_rn"), F.col("_rn"), F.col("_n"), F.col("_own")
    cells = sum((finite(F.col(c)).cast("int") for c in cols), F.lit(0))
    ahead = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead(y, lookback - 1 + h).over(w).cast("double").alias("y"), F.lead(order[0], lookback - 1 + h).over(w).alias("target_time")) for h in horizons))
    rows = df.withColumn("_cells", cells).select(
        *keys,
        place.cast("long").alias("start"),
        whole.alias("n"),
        there.alias("_there"),
        (F.sum("_cells").over(w.rowsBetween(0, lookback - 1)) / (lookback * len(cols))).alias("valid_ratio"),
        ahead.alias("ahead"),
    )
    rows = rows.where("_there").where(F.col("start") % stride == 0).select(*keys, "start", "n", "valid_ratio", F.explode("ahead").alias("a"))
    good = (F.col("start") <= F.col("n") - lookback - F.col("a.horizon")) & finite(F.col("a.y")) & (F.col("valid_ratio") >= min_ratio)
    return rows.where(good).select(*keys, F.col("a.horizon").alias("horizon"), "start", F.col("a.target_time").alias("target_time"), F.col("a.y").alias("y"), "valid_ratio")


def window_counts(df: DataFrame, lookback: int, horizon: int, stride: int, by: str = "station_id", split: Sequence[str] = ()) -> DataFrame:
    """(…, upper_bound, exact): the sum over stations of (n - L - H + 1) // stride, and the number that there are."""
    n = df.groupBy(by, *split).agg(F.count("*").alias("n"))
    room = F.greatest(F.lit(0), F.col("n") - lookback - horizon + 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return n.groupBy(*split).agg(total(F.floor(room / stride)).alias("upper_bound"), total(F.ceil(room / stride)).alias("exact"))


def window_tensors(
    df: DataFrame,
    index: DataFrame,
    cols: Sequence[str],
    lookback: int = LOOKBACK,
    block: int = 1024,
    order: Sequence[str] = ("Datetime",),
    by: str = "station_id",
    split: str | None = None,
    by_ranges: bool = False,
) -> DataFrame:
    """The index with X: `lookback` rows of the columns as floats, what isn't finite as 0.

    Rows are gathered in overlapping blocks, of `block` starts each, so a row is copied
    1 + lookback / block times and a station's tensors can take several tasks. Numbering its
    rows sorts a station in one, unless they are numbered by ranges (see slices).
    """
    keys = [by, split] if split else [by]
    w = Window.partitionBy(*keys).orderBy(*order)
    cells = F.array(*(F.when(finite(F.col(c)), F.col(c)).otherwise(0).cast("float") for c in cols))
    if by_ranges:
        rows = slices.number_rows(df.select(*dict.fromkeys([*keys, *order]), F.struct(*keys).alias("_series"), cells.alias("_x")), order, "_series")
    else:
        rows = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("_rn"), cells.alias("_x"))
    first = F.greatest(F.lit(0), F.floor((F.col("_rn") - lookback + 1) / block))
    dealt = rows.withColumn("_block", F.explode(F.sequence(first, F.floor(F.col("_rn") / block))))
    blocks = dealt.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_block").alias("_of_block")).agg(F.array_sort(F.collect_list(F.struct("_rn", "_x"))).alias("_rows"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.col("_block") == F.col("_of_block"))
    placed = index.withColumn("_block", F.floor(F.col("start") / block)).join(blocks, same)
    at = F.col("start") - F.col("_rows")[0]["_rn"] + 1
    x = F.transform(F.slice(F.col("_rows"), at.cast("int"), F.lit(lookback)), lambda r: r["_x"])
    return placed.withColumn("X", x).select(*index.columns, "X")


def window_summary(windows: DataFrame, lookback: int, features: int, split: str = "split") -> DataFrame:
    """(split, horizon, windows, t_min, t_max, f_min, f_max, y_min, y_max, mismatched).

    mismatched: windows of another length, with rows of another width, or without y.
    """
    t = F.size("X").cast("long")
    narrow, wide = F.array_min(F.transform("X", F.size)).cast("long"), F.array_max(F.transform("X", F.size)).cast("long")
    wrong = (t != lookback) | (narrow != features) | (wide != features) | ~finite(F.col("y"))
    return windows.groupBy(split, "horizon").agg(
        F.count("*").alias("windows"),
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        F.min(narrow).alias("f_min"),
        F.max(wide).alias("f_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.count_if(F.coalesce(wrong, F.lit(True))).alias("mismatched"),
    )


def _draw(by: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col("start").cast("string")))


def subsample(
    windows: DataFrame,
    frac: float | Mapping[str, float],
    least: int = 1,
    seed: str = "0",
    by: str = "station_id",
    keys: Sequence[str] = (),
    split: str = "split",
    by_ranges: bool = False,
) -> DataFrame:
    """Of each station (and further keys) max(least, ceil(frac * n)) windows, chosen by a hash; frac may depend on the split.

    By ranges a station's windows are ordered by several tasks (see slices), with the same result.
    """
    if isinstance(frac, Mapping):
        share = F.coalesce(F.create_map(*(x for s, f in frac.items() for x in (F.lit(s), F.lit(f))))[F.col(split)], F.lit(1.0))
        keys = [*dict.fromkeys([*keys, split])]
    else:
        share = F.lit(float(frac))
    if by_ranges:
        marked = windows.withColumns({"_series": F.struct(*dict.fromkeys([by, *keys])), "_drawn": _draw(by, seed)})
        rows = slices.number_rows(marked, ["_drawn", "start"], "_series", count="_all")
        kept = F.col("_rn") < F.greatest(F.lit(least), F.ceil(share * F.col("_all")))
        return rows.where(kept).select(*windows.columns)
    group = Window.partitionBy(by, *keys)
    k = F.greatest(F.lit(least), F.ceil(share * F.count("*").over(group)))
    rows = windows.withColumns({"_k": k, "_n": F.row_number().over(group.orderBy(_draw(by, seed), "start"))})
    return rows.where("_n <= _k").drop("_k", "_n")


def subsample_ends(windows: DataFrame, frac: float, end: str = "head", by: str = "station_id", order: str = "station", time: str = "target_time") -> DataFrame:
    """The first (or last) ceil(frac * N) windows: in order of station and start, or of time, station and start.

    All windows are numbered by ranges of that order (see slices), so no task holds them, a
    station or an hour.
    """
    in_all = [by, "start"] if order == "station" else [time, by, "start"]
    rows = slices.number_rows(windows.withColumn("_all_rows", F.lit(0)), in_all, "_all_rows", name="_at", count="_n")
    k = F.ceil(F.lit(frac) * F.col("_n"))
    kept = F.col("_at") < k if end == "head" else F.col("_at") >= F.col("_n") - k
    return rows.where(kept).select(*windows.columns)
