"""Lags, leads, rolling statistics and calendar features, by rows of a station in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import cyclic

LAGS = (1, 3, 6, 12, 24, 48)
WIDTHS = (6, 12, 24, 48, 72, 168)


def in_order(by: str | Sequence[str], order: Sequence[str]) -> WindowSpec:
    """by: a station, or the keys of a piece of one (see slices)."""
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)


def lag_columns(y: str, hours: Sequence[int], by: str | Sequence[str], order: Sequence[str], name: str = "{y}_lag{h}h") -> dict[str, Column]:
    w = in_order(by, order)
    return {name.format(y=y, h=h): F.lag(y, h).over(w) for h in hours}


def lags(df: DataFrame, y: str, hours: Sequence[int] = LAGS, order: Sequence[str] = ("Datetime",), by: str | Sequence[str] = "station_id") -> DataFrame:
    """Adds {y}_lag{h}h: y so many rows (not clock hours) before."""
    return df.withColumns(lag_columns(y, hours, by, order))


def lag_matrix(df: DataFrame, y: str, length: int, order: Sequence[str] = ("Datetime",), by: str | Sequence[str] = "station_id") -> DataFrame:
    """Adds {y}_lag1 ... {y}_lag{length}."""
    return df.withColumns(lag_columns(y, range(1, length + 1), by, order, "{y}_lag{h}"))


def lead_target(df: DataFrame, y: str, horizon: int, order: Sequence[str] = ("Datetime",), by: str | Sequence[str] = "station_id", name: str = "y_true") -> DataFrame:
    """Adds y so many rows ahead."""
    return df.withColumn(name, F.lead(y, horizon).over(in_order(by, order)))


def rolling_columns(cols: Sequence[str], widths: Sequence[int], by: str | Sequence[str], order: Sequence[str], closed: str = "current") -> dict[str, Column]:
    """closed "current": the last w rows with this one, from w // 2 values on, sample std.
    closed "past": the w rows before this one, from one value on, population std."""
    w, out = in_order(by, order), {}
    for c in cols:
        for n in widths:
            frame = w.rowsBetween(-(n - 1), 0) if closed == "current" else w.rowsBetween(-n, -1)
            least = max(1, n // 2) if closed == "current" else 1
            enough = F.count(c).over(frame) >= least
            std = F.stddev_samp(c) if closed == "current" else F.stddev_pop(c)
            suffix = "" if closed == "current" else "_past"
            out[f"{c}_roll{n}h_mean{suffix}"] = F.when(enough, F.avg(c).over(frame))
            out[f"{c}_roll{n}h_std{suffix}"] = F.when(enough, std.over(frame))
    return out


def rolling(df: DataFrame, cols: Sequence[str], widths: Sequence[int] = WIDTHS, closed: str = "current", order: Sequence[str] = ("Datetime",), by: str | Sequence[str] = "station_id") -> DataFrame:
    """Adds rolling means and standard deviations; all of them share one sort of the station."""
    return df.withColumns(rolling_columns(cols, widths, by, order, closed))


def calendar(df: DataFrame, time: str = "Datetime") -> DataFrame:
    """Adds hour_sin, hour_cos, dow_sin and dow_cos (Monday is 0)."""
    h, d = cyclic(F.hour(time), 24), cyclic(F.weekday(time), 7)
    return df.withColumns({"hour_sin": h[0], "hour_cos": h[1], "dow_sin": d[0], "dow_cos": d[1]})


def scope(df: DataFrame, ids: DataFrame | None = None, exclude: DataFrame | None = None, drop_years: Sequence[int] = (), time: str = "Datetime", by: str = "station_id") -> DataFrame:
    """Stations of a list, without those of another, and without some years; rows without a time stay."""
    if ids is not None:
        df = df.join(ids.toDF(by).distinct(), by, "left_semi")
    if exclude is not None:
        df = df.join(exclude.toDF(by).distinct(), by, "left_anti")
    if drop_years:
        df = df.where(F.col(time).isNull() | ~F.year(time).isin(list(drop_years)))
    return df
