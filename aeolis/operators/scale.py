"""Scaling by station, with the global parameters for stations that training hasn't seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, safe_div
from ..functions.quantiles import quantiles

KINDS = ("standard", "minmax", "robust")
QUARTILES = (0.25, 0.5, 0.75)


def _spread(q: Column) -> tuple[Column, Column]:
    return q[1].cast("double"), (q[2] - q[0]).cast("double")


def _fits(c: str, kind: str, exact: bool) -> tuple[Column, Column]:
    """Where a column's scale starts and how wide it is."""
    if kind == "standard":
        return F.avg(c), F.stddev_pop(c)
    if kind == "minmax":
        return F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")
    if kind == "robust":
        points = F.array(*map(F.lit, QUARTILES))
        return _spread(F.percentile(c, points) if exact else F.percentile_approx(c, points, 10_000))
    raise ValueError(f"unknown scaler {kind}")


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard", by: str = "station_id", split: str | None = "split", exact: bool = True) -> DataFrame:
    """(scope, station_id, column, loc, scale): parameters of the train rows, globally and for each station.

    robust takes medians and quartiles, exact ones or (for stations of many rows) approximate;
    exact global ones come from two passes, in which NaN counts as infinite.
    """
    train = df.where(F.col(split) == "train") if split else df
    both = lambda fit, c: F.struct(fit[0].alias("loc"), fit[1].alias("scale")).alias(c)
    fitted = [both(_fits(c, kind, exact), c) for c in cols]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c)["loc"].alias("loc"), F.col(c)["scale"].alias("scale")) for c in cols))

    def rows(agg: DataFrame, scope: str, station: Column) -> DataFrame:
        return agg.select(F.lit(scope).alias("scope"), station.alias(by), F.explode(cells).alias("x")).select("scope", by, "x.*")

    if kind == "robust" and exact:
        one = quantiles(train, {c: F.col(c) for c in cols}, QUARTILES).select(*(both(_spread(F.col(c)), c) for c in cols))
    else:
        one = train.agg(*fitted)
    whole = rows(one, "global", F.lit(None).cast(df.schema[by].dataType))
    return whole.unionByName(rows(train.groupBy(by).agg(*fitted), "station", F.col(by)))


def attach_params(df: DataFrame, params: DataFrame, cols: Sequence[str], by: str = "station_id") -> DataFrame:
    """Adds {c}__loc and {c}__scale: the station's, or the global ones if it has none."""
    pick = lambda c, what: F.max(F.when(F.col("column") == c, F.col(what)))
    wide = params.groupBy("scope", by).agg(*(F.struct(pick(c, "loc").alias("loc"), pick(c, "scale").alias("scale")).alias(c) for c in cols))
    own = wide.where("scope = 'station'").select(by, F.struct(*cols).alias("_own"))
    whole = wide.where("scope = 'global'").select(F.struct(*cols).alias("_all"))  # one row
    joined = df.join(own, by, "left").join(F.broadcast(whole), how="left")
    both = {f"{c}__{what}": F.coalesce(F.col("_own")[c][what], F.col("_all")[c][what]) for c in cols for what in ("loc", "scale")}
    return joined.withColumns(both).drop("_own", "_all")


def scale(df: DataFrame, params: DataFrame, cols: Sequence[str], by: str = "station_id", eps: float = EPS) -> DataFrame:
    """(x - loc) / scale; a scale nearer to 0 than eps counts as eps."""
    scaled = {c: safe_div(F.col(c) - F.col(f"{c}__loc"), F.col(f"{c}__scale"), eps) for c in cols}
    return attach_params(df, params, cols, by).withColumns(scaled).select(*df.columns)


def unscale(df: DataFrame, params: DataFrame, cols: Sequence[str], by: str = "station_id", eps: float = EPS) -> DataFrame:
    """The inverse of scale with the same parameters, of any kind, by station or global."""
    width = lambda c: F.when(F.abs(F.col(f"{c}__scale")) < eps, F.lit(eps)).otherwise(F.col(f"{c}__scale"))
    out = attach_params(df, params, cols, by).withColumns({c: F.col(c) * width(c) + F.col(f"{c}__loc") for c in cols})
    return out.select(*df.columns)
