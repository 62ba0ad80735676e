"""Column expressions: ids, times, numbers, metrics and losses."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest divisor that scaling uses.
EPS = 1e-8


def norm_id(c: Column) -> Column:
    """An id as text, without a trailing ".0" and blanks around; null stays null."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def parse_ts(c: Column) -> Column:
    """A time without zone; null if it can't be read."""
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


def parse_num(c: Column) -> Column:
    """A double; null if it can't be read or isn't a number."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def safe_div(x: Column, d: Column, eps: float = EPS) -> Column:
    return x / F.when(F.abs(d) < eps, F.lit(eps)).otherwise(d)


def clamp(c: Column, limit: float, nan: float = 0.0) -> Column:
    """NaN and null become `nan`, everything else is held within +-limit."""
    x = F.when(c.isNull() | F.isnan(c), F.lit(nan)).otherwise(c)
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def cyclic(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a part of a cycle."""
    angle = part * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# -- aggregates over pairs (y, p) of finite numbers -------------------------------------------
def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def smape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / (F.abs(y) + F.abs(p) + 1e-12)) * 200


def r2(y: Column, p: Column) -> Column:
    return 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y) + 1e-12)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"rmse": rmse, "mae": mae, "smape": smape, "r2": r2}


def loss(y: Column, p: Column, kind: str = "huber", delta: float = 1.0, clip_max: float | None = None, log1p: bool = False) -> Column:
    """Mean squared error or Huber loss, after clipping from above and log1p of what is positive."""
    for_both = [y, p]
    if clip_max is not None:
        for_both = [F.least(c, F.lit(clip_max)) for c in for_both]
    if log1p:
        for_both = [F.log1p(F.greatest(c, F.lit(0.0))) for c in for_both]
    error = for_both[0] - for_both[1]
    if kind == "mse":
        return F.avg(error * error)
    if kind != "huber":
        raise ValueError(f"unknown loss {kind}")
    return F.avg(F.when(F.abs(error) <= delta, error * error / 2).otherwise(delta * (F.abs(error) - delta / 2)))
