"""Scoring predictions (station_id, horizon, y_true, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import METRICS, clamp, finite, loss


def score(df: DataFrame, by: Sequence[str] = ("horizon",), y: str = "y_true", p: str = "y_pred", metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """The metrics and n of each group, over pairs that are finite; a group without any has nulls."""
    good = finite(F.col(y)) & finite(F.col(p))
    pair = df.select(*by, F.when(good, F.col(y)).alias("y"), F.when(good, F.col(p)).alias("p"))
    return pair.groupBy(*by).agg(F.count("y").alias("n"), *(METRICS[m](F.col("y"), F.col("p")).alias(m) for m in metrics))


def score_loss(df: DataFrame, by: Sequence[str] = ("horizon",), y: str = "y_true", p: str = "y_pred", **how: object) -> DataFrame:
    return df.groupBy(*by).agg(loss(F.col(y), F.col(p), **how).alias("loss"))


def rank_stations(scores: DataFrame, top: int = 10, metric: str = "rmse", by: str = "station_id") -> DataFrame:
    """(horizon, which, rank, station, metric): the best and the worst stations of each horizon."""
    out = []
    for which, order in (("best", F.asc(metric)), ("worst", F.desc(metric))):
        w = Window.partitionBy("horizon").orderBy(order, by)
        ranked = scores.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        out.append(ranked.select("horizon", F.lit(which).alias("which"), "rank", by, metric))
    return out[0].unionByName(out[1])


def top_residuals(df: DataFrame, top: int = 10, by: str = "station_id", tie: Sequence[str] = ()) -> DataFrame:
    """The largest absolute errors of each station."""
    errors = df.withColumn("abs_err", F.abs(F.col("y_true") - F.col("y_pred")))
    w = Window.partitionBy(by).orderBy(F.desc("abs_err"), *tie)
    return errors.where("abs_err is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def sanitize(df: DataFrame, cols: Sequence[str], limit: float = 10.0) -> DataFrame:
    """NaN and null to 0, infinities and what lies beyond to +-limit; array columns element by element."""

    def clean(c: str) -> Column:
        if df.schema[c].dataType.typeName() == "array":
            return F.transform(c, lambda x: clamp(x, limit))
        return clamp(F.col(c), limit)

    return df.withColumns({c: clean(c) for c in cols})
