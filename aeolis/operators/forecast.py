"""Forecast baselines: persistence, seasonal-naive, direct ridge."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import METRICS, finite
from .features import in_order, lag_columns


def _predictions(df: DataFrame, y: str, horizons: Sequence[int], by: str, order: Sequence[str], predictor) -> DataFrame:  # noqa: ANN001
    """(station, horizon, y_true, y_pred), where both are there; all horizons in one pass over a station."""
    w = in_order(by, order)
    made = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead(y, h).over(w).alias("y_true"), predictor(w, h).alias("y_pred")) for h in horizons))
    rows = df.select(by, made.alias("made")).select(by, F.explode("made").alias("p")).select(by, "p.*")
    return rows.where("y_true is not null and y_pred is not null")


def persistence(df: DataFrame, y: str, horizons: Sequence[int] = (1,), by: str = "station_id", order: Sequence[str] = ("Datetime",)) -> DataFrame:
    """The value h rows ahead is what it is now."""
    return _predictions(df, y, horizons, by, order, lambda w, h: F.col(y))


def seasonal(df: DataFrame, y: str, horizons: Sequence[int] = (1,), period: int = 168, aligned: bool = False, by: str = "station_id", order: Sequence[str] = ("Datetime",)) -> DataFrame:
    """The value h rows ahead is that of `period` rows before now, or, if aligned, before then."""
    return _predictions(df, y, horizons, by, order, lambda w, h: F.lag(y, period - h if aligned else period).over(w))


def gram(rows: DataFrame, lags: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(target, n, sums): of each target the sums of products of (1, lags, target), over rows whose target is there, as one flat matrix.

    One pass over the rows: each task adds up the products of its own rows, a matrix product of
    a batch at a time, and sends one matrix a target. The sums of the tasks are added in Spark.
    """
    width = len(lags) + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(targets), width, width))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in lags)])
            for k, c in enumerate(targets):
                y = batch.column(c).to_numpy(zero_copy_only=False)  # nulls are NaN here
                there = ~np.isnan(y)
                own = np.column_stack([x[there], y[there]])
                total[k] += own.T @ own
        cells = pa.array([m.ravel() for m in total], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(targets)), pa.int32()), cells], names=["target", "cells"])

    each = rows.select(*lags, *targets).mapInArrow(sums, "target int, cells array<double>")
    flat = each.select("target", F.posexplode("cells").alias("at", "x")).groupBy("target", "at").agg(F.sum("x").alias("x"))
    return flat.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("sums"))


def ridge_weights(sums: Sequence[float], alpha: float) -> np.ndarray | None:
    """Intercept and weights of the ridge fit with these sums; None without rows or where the target doesn't vary.

    The intercept isn't penalised: the centred normal equations (S + alpha I) w = c are solved.
    """
    width = math.isqrt(len(sums))
    m = np.array(sums).reshape(width, width)
    n = m[0, 0]
    if not n:
        return None
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    if centred[-1, -1] <= 1e-12 * m[-1, -1]:
        return None
    w = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(width - 2), centred[:-1, -1])
    return np.r_[mean[-1] - mean[:-1] @ w, w]


def ridge_direct(
    train: DataFrame,
    test: DataFrame,
    y: str,
    horizons: int | Sequence[int] = 1,
    lookback: int = 168,
    alpha: float = 1.0,
    by: str = "station_id",
    order: Sequence[str] = ("Datetime",),
) -> DataFrame:
    """(station, horizon, y_true, y_pred): ridge regression on the last `lookback` values before each row, a model a horizon.

    Pooled over stations, with an intercept, on rows without gaps. All horizons are fitted from
    one pass over the training rows (see gram), whose result has (lookback + 2)^2 numbers a
    horizon, and predicted in one over the test rows. Values are taken relative to the training
    mean, so that sums of squares keep their digits. A horizon has no rows if either side has no
    complete row for it, or the label doesn't vary. NaN is no value.
    """
    horizons, lags = [horizons] if isinstance(horizons, int) else list(horizons), [f"lag{k}" for k in range(1, lookback + 1)]
    targets = [f"y{h}" for h in horizons]
    middle = train.agg(F.avg(F.when(finite(F.col(y)), F.col(y).cast("double")))).first()[0] or 0.0

    def complete(df: DataFrame) -> DataFrame:
        df = df.withColumn(y, F.when(finite(F.col(y)), F.col(y).cast("double") - middle))
        made = lag_columns(y, range(1, lookback + 1), by, order, "lag{h}") | {f"y{h}": F.lead(y, h).over(in_order(by, order)) for h in horizons}
        return df.select(by, *(c.alias(n) for n, c in made.items())).dropna(subset=lags)

    fitted = {r.target: ridge_weights(r.sums, alpha) for r in gram(complete(train), lags, targets).collect()}  # a row a horizon
    made = []
    for k, h in enumerate(horizons):
        weights = fitted.get(k)
        if weights is not None:
            terms = F.zip_with(F.array(*lags), F.array(*map(F.lit, weights[1:].tolist())), lambda x, w: x * w)
            predicted = F.aggregate(terms, F.lit(float(weights[0] + middle)), lambda a, x: a + x)
            made.append(F.struct(F.lit(h).alias("horizon"), (F.col(f"y{h}") + middle).alias("y_true"), predicted.alias("y_pred")))
    if not made:
        return test.select(by, F.lit(0).alias("horizon"), F.lit(0.0).alias("y_true"), F.lit(0.0).alias("y_pred")).limit(0)
    return complete(test).select(by, F.explode(F.array(*made)).alias("p")).select(by, "p.*").where("y_true is not null")


def baseline_report(methods: dict[str, DataFrame], horizons: Sequence[int]) -> DataFrame:
    """(method, horizon, rmse, mae, smape, r2, note); a method without valid rows at a horizon gets a note."""
    spark = next(iter(methods.values())).sparkSession
    scores: list[DataFrame] = []
    for method, predictions in methods.items():
        made: list[Column] = [f(F.col("y_true"), F.col("y_pred")).alias(name) for name, f in METRICS.items()]
        scores.append(predictions.groupBy("horizon").agg(*made).select(F.lit(method).alias("method"), "horizon", *METRICS))
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    wanted = spark.createDataFrame([(m, h) for m in methods for h in horizons], "method string, horizon int")
    note = F.when(F.col("rmse").isNull(), F.concat(F.lit("no valid rows for "), F.col("method")))
    return wanted.join(out, ["method", "horizon"], "left").withColumn("note", note)
