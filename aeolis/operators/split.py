"""Splits by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_split(df: DataFrame, train_end: str, val_end: str, time: str = "Datetime") -> DataFrame:
    """Adds split: train up to and with train_end, val up to and with val_end, then test. Rows without a time go.

    A date stands for its midnight, so the rest of that day belongs to the next split.
    """
    t, a, b = F.col(time), F.lit(train_end).cast("timestamp_ntz"), F.lit(val_end).cast("timestamp_ntz")
    label = F.when(t <= a, "train").when(t <= b, "val").when(t > b, "test")
    return df.withColumn("split", label).where("split is not null")


def split_summary(df: DataFrame, time: str = "Datetime", by: str = "station_id") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct(by).alias("stations"), F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def union_splits(*parts: DataFrame) -> DataFrame:
    """Splits in one table; columns that some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
