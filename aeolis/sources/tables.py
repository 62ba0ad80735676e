"""Reading and writing: raw files, dimensions, station-partitioned panels, window shards, reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import norm_id
from ..functions.schema import canonicalize

#: Rows of a window file at most.
SHARD_ROWS = 30_000
#: Rows of a directory that stations share, about.
SHARE_ROWS = 1_000_000
#: The partition column of such directories.
SHARE = "station_share"


def read_raw(spark: SparkSession, path: str, common: Mapping[str, Any] | None = None, own: Mapping[str, Any] | None = None) -> DataFrame:
    """A CSV file with common options, overlaid by its own. Rows that don't fit are read with nulls."""
    options = {"header": "true", "mode": "PERMISSIVE"} | dict(common or {}) | dict(own or {})
    return spark.read.options(**options).csv(path)


def ingest(spark: SparkSession, sources: Mapping[str, Any], common: Mapping[str, Any] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Lazy tables of several files, and a table (key, status) of what was found.

    An entry is a path, or a mapping with path, read (options) and name; one without a path is skipped.
    """
    tables, status = {}, []
    for key, entry in sources.items():
        spec = {"path": entry} if isinstance(entry, str) else dict(entry or {})
        if spec.get("path"):
            tables[spec.get("name", key)] = read_raw(spark, spec["path"], common, spec.get("read"))
        status.append((key, "read" if spec.get("path") else "skipped"))
    return tables, spark.createDataFrame(status, "key string, status string")


def output_name(key: str, fmt: str, pattern: str = "{key}.{ext}") -> str:
    return pattern.format(key=key, ext=fmt)


def sink(df: DataFrame, path: str, fmt: str = "parquet", options: Mapping[str, Any] | None = None, mode: str = "overwrite") -> None:
    """Writes parquet, csv, json or orc; csv gets a header line unless told otherwise."""
    df.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | dict(options or {})).mode(mode).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table, pruned to those of the columns that it has."""
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    df = (reader.schema(schema) if schema else reader).format(fmt).load(path)
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def time_filter(df: DataFrame, time: str, start: Any = None, end: Any = None) -> DataFrame:
    """Rows within a time range, both ends included; an end that is None is open."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast(df.schema[time].dataType))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast(df.schema[time].dataType))
    return df


def id_filter(df: DataFrame, column: str, ids: DataFrame | Iterable[Any], exclude: bool = False) -> DataFrame:
    """Rows whose id, as text, is (or isn't) among a column of ids or a few given ones."""
    own = norm_id(F.col(column))
    if not isinstance(ids, DataFrame):
        inside = F.coalesce(own.isin([str(i) for i in ids]), F.lit(False))
        return df.where(~inside if exclude else inside)
    wanted = ids.select(norm_id(F.col(ids.columns[0])).alias("_id")).distinct()
    return df.join(wanted, own == F.col("_id"), "left_anti" if exclude else "left_semi")


def load_dimension(spark: SparkSession, path: str | None, aliases: Mapping[str, Iterable[str]], ids: Sequence[str], fmt: str = "csv") -> DataFrame | None:
    """A small table with canonical keys and normalised ids; None without a path."""
    if not path:
        return None
    return dimension(read_table(spark, path, fmt), aliases, ids)


def dimension(df: DataFrame, aliases: Mapping[str, Iterable[str]], ids: Sequence[str]) -> DataFrame:
    named = canonicalize(df, aliases)
    return named.withColumns({c: norm_id(F.col(c)) for c in ids if c in named.columns})


def write_panel(df: DataFrame, path: str, by: str = "station_id", files: int = 1, rows: int | None = None) -> None:
    """One directory a station, replacing what was there; a station of many rows may take several files.

    With rows, stations share directories by their hash, of about so many rows each, so that
    their number follows the table's rows and not its stations; each is sorted by station.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    if rows is None:
        df.repartition(by, salt).write.mode("overwrite").partitionBy(by).parquet(path)
        return
    shares = max(1, -(-df.count() // rows))
    dealt = df.withColumn(SHARE, F.pmod(F.xxhash64(by), F.lit(shares)).cast("int")).repartition(shares * files, SHARE, salt)
    dealt.sortWithinPartitions(SHARE, by).write.mode("overwrite").partitionBy(SHARE).parquet(path)


def read_panel(spark: SparkSession, path: str, by: str = "station_id", merge: bool = True) -> DataFrame:
    """A partitioned panel; files may have different columns. The partition column is text; the directories that stations share are none."""
    df = spark.read.option("mergeSchema", str(merge).lower()).parquet(path).drop(SHARE)
    return df.withColumn(by, norm_id(F.col(by)))


def write_ids(df: DataFrame, path: str, column: str = "station_id") -> None:
    """A list of ids, one a line."""
    df.select(norm_id(F.col(column)).alias("value")).where("value is not null").write.mode("overwrite").text(path)


def read_keep_list(spark: SparkSession, path: str) -> DataFrame:
    """(station_id) of a list with comments (#) and blank lines; a list without ids is an error."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("station_id"))
    ids = lines.where("station_id <> ''").distinct()
    if ids.isEmpty():
        raise ValueError(f"no station ids in {path}")
    return ids


def write_window_shards(windows: DataFrame, path: str, rows: int = SHARD_ROWS) -> None:
    """Windows under split=S/h=H, so many rows a file at most."""
    out = windows.withColumnRenamed("horizon", "h")
    out.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("split", "h").parquet(path)


def window_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, horizon, files, windows, largest) of written windows; largest: windows of the largest file."""
    stored = spark.read.parquet(path).groupBy("split", F.col("h").alias("horizon"), F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_n"))
    return stored.groupBy("split", "horizon").agg(F.count("*").alias("files"), F.sum("_n").alias("windows"), F.max("_n").alias("largest"))


def write_reports(reports: Mapping[str, DataFrame], folder: str, fmt: str = "json") -> None:
    """Small result tables, each in a folder of its own."""
    for name, df in reports.items():
        sink(df.coalesce(1), f"{folder.rstrip('/')}/{output_name(name, fmt)}", fmt)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, under spark.checkpoint.dir, or where all is one process a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="aeolis-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
