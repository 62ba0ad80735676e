"""Distributions as tables: density histograms and kernel density estimates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from ..functions.quantiles import quantiles

EDGES = 60


def bin_range(df: DataFrame, c: str) -> tuple[float, float]:
    """The 0.5 and 99.5 percentiles of the finite values, or if these agree least and largest; -1 and 1 without values."""
    x = F.when(finite(F.col(c)), F.col(c).cast("double"))
    n, least, most = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return -1.0, 1.0
    low, high = quantiles(df, {"q": x}, (0.005, 0.995), count=n).first().q
    return (low, high) if low != high else (least, most + 1e-6)


def histogram(df: DataFrame, c: str, split: str = "split", edges: int = EDGES) -> DataFrame:
    """(split, bin, mid, density) over a common range of all splits; empty bins are left out.

    Density is normalised over the values in range; the last bin is closed.
    """
    bins, (lo, hi) = edges - 1, bin_range(df, c)
    width = (hi - lo) / bins
    rows = df.where(finite(F.col(c))).select(split, F.col(c).cast("double").alias("x")).where(F.col("x").between(lo, hi))
    n = rows.groupBy(split, F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(split))  # over at most `bins` rows a split
    return n.select(split, "bin", (lo + (F.col("bin") + 0.5) * width).alias("mid"), (F.col("n") / (total * width)).alias("density"))


#: Cells of a bandwidth, and the powers of a value's distance from its cell's middle that are summed.
CELLS, POWERS = 256, 5


def kde(df: DataFrame, c: str, split: str = "split", edges: int = EDGES) -> DataFrame:
    """(split, bin, mid, density): a Gaussian kernel estimate at the middles of the histogram's bins.

    The bandwidth is 1.06 std n^(-1/5), or 1 if std is 0 or undefined. Values are summed up in
    cells of a 256th of it first, by powers of their distance from the cell's middle; the kernel
    at a bin's middle is then its expansion about the cell's, sum of He_k(u) K(u) d^k / k!, so
    exponentials are taken for each cell and bin instead of each value and bin. What is left out, He_5(u) K(u)
    d^5 / 120 with |d| <= 1/512, is below 1e-14 of a kernel's height.
    """
    bins, (lo, hi) = edges - 1, bin_range(df, c)
    rows = df.where(finite(F.col(c))).select(F.col(split).alias("_s"), F.col(c).cast("double").alias("x"))
    width = rows.groupBy("_s").agg(F.stddev_samp("x").alias("std"), F.count("x").alias("n"))
    bandwidth = F.when(F.col("std") > 0, F.lit(1.06) * F.col("std") * F.pow("n", F.lit(-0.2))).otherwise(1.0)
    spans = width.select(F.col("_s").alias(split), bandwidth.alias("bw"), "n")  # a row a split
    placed = rows.join(spans, F.col("_s").eqNullSafe(F.col(split))).withColumn("cell", F.rint(F.col("x") / F.col("bw") * CELLS))
    d = F.col("x") / F.col("bw") - F.col("cell") / CELLS
    powers = [reduce(lambda a, _: a * d, range(k), F.lit(1.0)) for k in range(POWERS)]
    cells = placed.groupBy(split, "bw", "n", "cell").agg(*(F.sum(m).alias(f"m{k}") for k, m in enumerate(powers)))

    mid = lo + (F.col("bin") + 0.5) * (hi - lo) / bins
    near = cells.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("u", mid / F.col("bw") - F.col("cell") / CELLS)
    u, hermite = F.col("u"), [F.lit(1.0), F.col("u")]
    for k in range(2, POWERS):
        hermite.append(u * hermite[-1] - (k - 1) * hermite[-2])
    terms = reduce(lambda a, b: a + b, (F.col(f"m{k}") * h / math.factorial(k) for k, h in enumerate(hermite)))
    kernel = F.when(F.abs(u) < 40, F.exp(-0.5 * u * u) * terms).otherwise(0.0)
    sums = near.groupBy(split, "bw", "n", "bin").agg(F.sum(kernel).alias("sum"))
    density = F.col("sum") / F.col("n") / (F.col("bw") * F.sqrt(F.lit(2.0) * F.pi()))
    return sums.select(split, F.col("bin").cast("long").alias("bin"), mid.alias("mid"), density.alias("density"))
