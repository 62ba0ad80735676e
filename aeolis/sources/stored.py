"""A panel stored in buckets of its keys: later stages by those keys need no shuffle, and keys are replaced without writing the rest anew.

The table is bucketed by its keys and partitioned by generation. A replacement appends a generation
that holds the new keys' rows only, and counts from the moment its number is published, which is one
row in one file; an interrupted one is never seen. Of each key the rows of its latest published
generation count; they stand in one bucket, so finding them takes no shuffle. With a second key,
such as a month, a station of very many rows takes several buckets and is replaced by the month.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("station_id",)


def _published(path: str) -> str:
    return f"{path.rstrip('/')}-published"


def _dealt(df: DataFrame, generation: int, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows dealt as the buckets are, so that a task writes one file."""
    return df.withColumn("generation", F.lit(generation)).repartition(buckets, *keys)


def _append(df: DataFrame, table: str, path: str, generation: int, keys: Sequence[str], order: Sequence[str], buckets: int) -> None:
    writer = _dealt(df, generation, keys, buckets).write.partitionBy("generation").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("path", path).mode("append").saveAsTable(table)


def _publish(spark: SparkSession, path: str, generation: int) -> None:
    spark.range(1).select(F.lit(generation).alias("generation")).coalesce(1).write.mode("append").parquet(_published(path))


def create(df: DataFrame, table: str, path: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("Datetime",), buckets: int = 200) -> None:
    """Stores a panel under a table's name; an error if there is one. Rows with null keys are one key."""
    if df.sparkSession.catalog.tableExists(table):
        raise ValueError(f"table {table} is there already")
    _append(df, table, path, 0, keys, order, buckets)
    _publish(df.sparkSession, path, 0)


def replace(df: DataFrame, table: str, path: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("Datetime",), buckets: int = 200) -> int:
    """All rows of the keys that df holds become df's; other keys keep theirs, new ones are added. Gives the generation.

    Settings are those of `create`. A number that an interrupted replacement used isn't used again.
    """
    spark = df.sparkSession
    used = spark.read.table(table).agg(F.max("generation").alias("g")).first().g  # from the partitions' names
    generation = (-1 if used is None else used) + 1
    _append(df.select(*(c for c in spark.read.table(table).columns if c != "generation")), table, path, generation, keys, order, buckets)
    _publish(spark, path, generation)
    return generation


def read(spark: SparkSession, table: str, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The panel as it is now. Groups, joins and windows by `keys` run on the buckets as they lie."""
    known = [r.generation for r in spark.read.parquet(_published(path)).distinct().collect()]  # one number a replacement
    rows = spark.read.table(table).where(F.col("generation").isin(known))
    if len(known) > 1:
        rows = rows.withColumn("_latest", F.max("generation").over(Window.partitionBy(*keys))).where("generation = _latest").drop("_latest")
    return rows.drop("generation")


def compact(spark: SparkSession, table: str, path: str, new_table: str, new_path: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("Datetime",), buckets: int = 200) -> None:
    """The panel as it is now, as a new table of one generation; readers change over when they like."""
    create(read(spark, table, path, keys), new_table, new_path, keys, order, buckets)
