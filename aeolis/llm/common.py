"""What several of the operators share: tables, word splitting, the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


#: So that Python workers, which Spark keeps from stage to stage, give freed buffers back to the system.
GIVE_BACK = {"MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def session(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it is used from a source tree, and give memory back."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for name, value in GIVE_BACK.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or where driver and executors are one process a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="aeolis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that nothing before it is computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan, dealt out anew if it has fewer partitions than there are cores to work on it (a small file, say).

    Only for plans without a shuffle: counting partitions would run those.
    """
    cores = session(df.sparkSession).sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as none. Without separators at its ends split() adds no empty words."""
    sep = "[\\x20\\x09-\\x0D]+"
    bare = F.regexp_replace(text, f"\\A{sep}|{sep}\\z", "")
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, sep))).cast("long")


#: Rows up to which a table of a few numbers and a name is broadcast.
FEW_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count of its rows allows it; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df
