"""Series cut into slices of rows with what stands around them, so that one station takes several tasks.

Rows are numbered station by station without gathering one: the table is dealt out by ranges of
(station, order), each range is numbered by itself, and counts of the ranges before are added. A
slice holds `size` rows of a station and a halo: the rows before (and after) it that lags, fills,
rolling frames and windows of its rows reach back (and ahead) to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.tables import scratch_dir

#: Rows of a slice, without its halo.
SIZE = 1 << 18


def number_rows(df: DataFrame, order: Sequence[str] = ("Datetime",), by: str = "station_id", parts: int | None = None, name: str = "_rn", count: str | None = None) -> DataFrame:
    """df with the place of each row in its station's order, from 0; with `count` also the station's number of rows.

    Rows that agree in station and order lie in one range, in no certain order. Null stations are
    one station. The ranges are written to the shared folder once, so that numbers and counts
    come from the same rows whatever is computed again.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark, "ranges")
    df.repartitionByRange(parts, by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema, T.StructField("_part", T.IntegerType())])).parquet(path)
    each = rows.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))  # a row a station and range
    before = Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("_by"))})
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1
    joined = rows.withColumn("_own", own).join(each, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    made = {name: (F.col("_before") + F.col("_own")).cast("long")} | ({count: F.col("_all")} if count else {})
    return joined.withColumns(made).select(*df.columns, *made)


def with_halo(numbered: DataFrame, before: int, after: int = 0, size: int = SIZE) -> DataFrame:
    """Each row once in its slice (`_slice`, `_own` true) and once more in every slice whose halo it is in."""
    at = F.floor(F.col("_rn") / size)
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_rn") - after) / size)), F.floor((F.col("_rn") + before) / size)
    return numbered.withColumn("_slice", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_slice") == at)


def by_slices(
    df: DataFrame,
    evaluate: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame],
    before: int,
    after: int = 0,
    size: int = SIZE,
    order: Sequence[str] = ("Datetime",),
    by: str = "station_id",
) -> DataFrame:
    """evaluate(rows, keys, order) over slices instead of stations; it gives rows back, with columns added or replaced.

    before and after are how many rows of its station a row's result depends on, in a chain of
    steps the sum of theirs (ffill 6 and then a mean of 24: 30). The results are those over whole
    stations; no task holds a station that is longer than a slice and its halo.
    """
    rows = with_halo(number_rows(df, order, by), before, after, size)
    return evaluate(rows, [by, "_slice"], ["_rn"]).where("_own").drop("_own", "_slice", "_rn")
