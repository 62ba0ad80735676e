"""Audits: coverage, duplicates, statistics, schema, leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from .features import lag_columns, rolling_columns


def _cells(cols: Sequence[str], make) -> Column:  # noqa: ANN001
    """An array of (column, ...) structs, to turn columns into rows without scanning twice."""
    return F.array(*(F.struct(F.lit(c).alias("column"), *make(c)) for c in cols))


def schema_audit(df: DataFrame, cols: Sequence[str], expected: Sequence[str], by: str = "station_id") -> DataFrame:
    """(column, in_any, in_all, expected): whether columns hold a value in some and in every station."""
    held = df.groupBy(by).agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in cols))
    once = held.agg(*(F.struct(F.bool_or(c).alias("any"), F.bool_and(c).alias("all")).alias(c) for c in cols))
    cells = _cells(cols, lambda c: (F.coalesce(F.col(c)["any"], F.lit(False)).alias("in_any"), F.coalesce(F.col(c)["all"], F.lit(False)).alias("in_all")))
    rows = once.select(F.explode(cells).alias("x")).select("x.column", "x.in_any", "x.in_all")
    return rows.withColumn("expected", F.col("column").isin(list(expected)))


def coverage(df: DataFrame, cols: Sequence[str], by: str = "station_id") -> DataFrame:
    """rowcount, and for each column its non-null count and their ratio to 3 places, a station."""
    counts = df.groupBy(by).agg(F.count("*").alias("rowcount"), *(F.count(c).alias(f"{c}_non_null") for c in cols))
    return counts.withColumns({f"{c}_coverage": F.round(F.col(f"{c}_non_null") / F.col("rowcount"), 3) for c in cols})


def coverage_flags(covered: DataFrame, core: Sequence[str], forecast: Sequence[str] = (), least: float = 0.70) -> DataFrame:
    """Adds the mean coverage of core and forecast columns, and whether the core's is below `least`."""

    def mean(cols: Sequence[str]) -> Column:
        ratios = F.filter(F.array(*(F.col(f"{c}_coverage") for c in cols)), lambda x: x.isNotNull())
        return F.when(F.size(ratios) > 0, F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / F.size(ratios)) if cols else F.lit(None).cast("double")

    out = covered.withColumn("overall_core_coverage", mean(core)).withColumn("overall_forecast_coverage", mean(forecast))
    return out.withColumn("flag_exclude", F.coalesce(F.col("overall_core_coverage") < least, F.lit(True)))


def coverage_report(flagged: DataFrame) -> DataFrame:
    """One row: stations, rows, kept, excluded and mean coverages."""
    return flagged.agg(
        F.count("*").alias("stations"),
        F.coalesce(F.sum("rowcount"), F.lit(0)).alias("rows"),
        F.count_if(~F.col("flag_exclude")).alias("kept"),
        F.count_if("flag_exclude").alias("excluded"),
        F.avg("overall_core_coverage").alias("mean_core_coverage"),
        F.avg("overall_forecast_coverage").alias("mean_forecast_coverage"),
    )


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows that share their key with another, and keys of such rows; nulls if a key column is absent."""
    if any(k not in df.columns for k in keys):
        none = F.lit(None).cast("long")
        return df.agg(F.count("*").alias("rows"), none.alias("duplicate_rows"), none.alias("duplicate_groups"))
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return n.agg(total(F.sum("n")).alias("rows"), total(F.sum(F.when(F.col("n") > 1, F.col("n")))).alias("duplicate_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def duplicate_top(df: DataFrame, keys: Sequence[str], by: str = "station_id", top: int = 10) -> DataFrame:
    """The stations with most rows that share their key with another."""
    groups = df.groupBy(*dict.fromkeys([by, *keys])).agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy(by).agg(F.sum("n").alias("duplicate_rows")).orderBy(F.desc("duplicate_rows"), by).limit(top)


def quick_stats(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """(split, column, n, mean, std, min, max) of non-null values; std is the sample's."""
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(split).agg(*(f(F.col(c).cast("double")).alias(f"{c}|{name}") for c in cols for name, f in parts.items()))
    cells = _cells(cols, lambda c: tuple(F.col(f"`{c}|{name}`").alias(name) for name in parts))
    return wide.select(split, F.explode(cells).alias("x")).select(split, "x.*")


def quick_stats_locked(df: DataFrame, target: str, lock: DataFrame, k: int = 8, split: str = "split") -> DataFrame:
    """quick_stats of the target and the first k columns of a feature lock (pos, column)."""
    first = [r.column for r in lock.where(F.col("column") != target).orderBy("pos").limit(k).collect()]  # k names
    return quick_stats(df, [target, *first], split)


def split_health(df: DataFrame, time: str, cols: Sequence[str], by: str = "station_id", split: str = "split") -> DataFrame:
    """rows, stations, time range and the share of nulls of each column, a split."""
    rates = (F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null_rate") for c in cols)
    return df.groupBy(split).agg(F.count("*").alias("rows"), F.countDistinct(by).alias("stations"), F.min(time).alias("min_time"), F.max(time).alias("max_time"), *rates)


def shape_line(df: DataFrame, label: str, time: str, by: str = "station_id") -> DataFrame:
    """One row: label, rows, stations, columns, time range."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(by).alias("stations"), F.min(time).alias("min_time"), F.max(time).alias("max_time")).select(
        F.lit(label).alias("label"), "rows", "stations", F.lit(len(df.columns)).cast("long").alias("columns"), "min_time", "max_time"
    )


# -- leakage ----------------------------------------------------------------------------------
def monotonic_check(df: DataFrame, time: str, order: str, by: str = "station_id") -> DataFrame:
    """(station, backwards): how often the time goes back in the stored order."""
    before = F.lag(time).over(Window.partitionBy(by).orderBy(order))
    steps = df.select(by, (F.col(time) < before).alias("back"))
    return steps.groupBy(by).agg(F.count_if("back").alias("backwards"))


def _compared(df: DataFrame, again: dict[str, Column], tolerance: float, check: str) -> DataFrame:
    """(check, column, max_diff, mismatches, ok) of stored columns against recomputed ones; a null against a value is a mismatch."""
    both = df.select(*(F.struct(F.col(c).alias("stored"), e.alias("again")).alias(c) for c, e in again.items()))
    diff = lambda c: F.abs(F.col(c)["stored"] - F.col(c)["again"])
    odd = lambda c: F.col(c)["stored"].isNull() != F.col(c)["again"].isNull()
    once = both.agg(*(F.struct(F.coalesce(F.max(diff(c)), F.lit(0.0)).alias("max_diff"), F.count_if(odd(c)).alias("mismatches")).alias(c) for c in again))
    rows = once.select(F.explode(_cells(list(again), lambda c: (F.col(c)["max_diff"].alias("max_diff"), F.col(c)["mismatches"].alias("mismatches")))).alias("x")).select("x.*")
    return rows.select(F.lit(check).alias("check"), "column", "max_diff", "mismatches", ((F.col("max_diff") <= tolerance) & (F.col("mismatches") == 0)).alias("ok"))


def lag_check(df: DataFrame, y: str, hours: Sequence[int], order: Sequence[str], by: str = "station_id", tolerance: float = 1e-8) -> DataFrame:
    """Stored lags against lags computed anew."""
    return _compared(df, lag_columns(y, hours, by, order), tolerance, "lags")


def roll_check(df: DataFrame, cols: Sequence[str], widths: Sequence[int], order: Sequence[str], by: str = "station_id", closed: str = "current", tolerance: float = 1e-6) -> DataFrame:
    """Stored rolling statistics against ones computed anew, by either definition."""
    return _compared(df, rolling_columns(cols, widths, by, order, closed), tolerance, "rolls")


def split_check(df: DataFrame, time: str, train_end: str, val_end: str, split: str = "split") -> DataFrame:
    """(check, column, max_diff, mismatches, ok): rows of each split beyond its bounds."""
    t, a, b = F.col(time), F.lit(train_end).cast("timestamp_ntz"), F.lit(val_end).cast("timestamp_ntz")
    wrong = {"train": t > a, "val": (t <= a) | (t > b), "test": t <= b}
    once = df.agg(*(F.count_if((F.col(split) == s) & w).alias(s) for s, w in wrong.items()))
    rows = once.select(F.explode(_cells(list(wrong), lambda s: (F.col(s).alias("mismatches"),))).alias("x")).select("x.*")
    return rows.select(F.lit("splits").alias("check"), "column", F.lit(0.0).alias("max_diff"), "mismatches", (F.col("mismatches") == 0).alias("ok"))


def check_report(*checks: DataFrame) -> DataFrame:
    """All checks' rows in one table."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def finite_pairs(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows where both are finite, and (…, kept, dropped) counts."""
    good = finite(F.col(y)) & finite(F.col(p))
    return df.where(good), df.groupBy(*by).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))
