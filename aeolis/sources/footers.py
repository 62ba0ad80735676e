"""Which columns a stored panel has and how full they are, from Parquet footers: no value is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def footers(spark: SparkSession, path: str, by: str = "station_id") -> DataFrame:
    """(station, file, column, rows, non_null): a row a file and top-level column.

    Files are listed by Spark with the stations of their folders, and tasks read their footers. A
    column that a file doesn't have has no row. non_null is null where a footer can't tell: nested
    columns, or chunks without statistics. NaN counts as a value there. A file without columns but
    the station's has one row whose column is null, so that its rows count.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.col(by).cast("string").alias(by) if by in files.columns else F.lit(None).cast("string").alias(by), F.col("path").alias("file"))

    def read(batches):  # noqa: ANN001, ANN202
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            out = {by: [], "file": [], "column": [], "rows": [], "non_null": []}
            for station, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # Hadoop writes file:/a where Arrow reads file:///a, and names as they are, where Arrow undoes escapes.
                scheme, rest = file.split(":", 1)
                host, name = ("", rest) if not rest.startswith("//") else (rest[2:].partition("/")[0], "/" + rest[2:].partition("/")[2])
                system, place = fs.FileSystem.from_uri(f"{scheme}://{host}{quote(name)}")
                meta = pq.read_metadata(place, filesystem=system)
                leaves = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                for name in meta.schema.to_arrow_schema().names or [None]:
                    filled = None
                    if name in leaves:
                        stats = [g.column(leaves[name]).statistics for g in groups]
                        if all(s is not None and s.has_null_count for s in stats):
                            filled = meta.num_rows - sum(s.null_count for s in stats)
                    for key, value in zip(out, (station, file, name, meta.num_rows, filled), strict=True):
                        out[key].append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return files.mapInArrow(read, f"`{by}` string, file string, column string, rows long, non_null long")


def schema_audit(found: DataFrame, expected: Sequence[str], by: str = "station_id") -> DataFrame:
    """(column, in_any, in_all, expected): whether some and all stations' files have a column; expected ones that none has are listed."""
    stations = found.agg(F.countDistinct(F.coalesce(F.col(by), F.lit("")))).scalar()
    held = found.where("column is not null").groupBy("column").agg(F.countDistinct(F.coalesce(F.col(by), F.lit(""))).alias("_n"))
    held = held.select("column", F.lit(True).alias("in_any"), (F.col("_n") == stations).alias("in_all"))
    named = found.sparkSession.createDataFrame([(c,) for c in expected], "column string")
    rows = held.join(named.withColumn("expected", F.lit(True)), "column", "full")
    return rows.select("column", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("in_any", "in_all", "expected")))


def coverage(found: DataFrame, cols: Sequence[str], by: str = "station_id") -> DataFrame:
    """As quality.coverage: rowcount, and for each column its non-null count and their ratio to 3 places, a station.

    A column that a file doesn't have is empty there; where a footer can't tell, count and ratio are null.
    """
    # A file's rows stand in each of its columns' rows: one of them tells.
    files = found.groupBy(by, "file").agg(
        F.max("rows").alias("_rows"),
        *(F.max(F.when(F.col("column") == c, F.struct("non_null"))).alias(f"_{i}") for i, c in enumerate(cols)),
    )
    unsure = lambda i: F.bool_or(F.col(f"_{i}").isNotNull() & F.col(f"_{i}.non_null").isNull())
    filled = lambda i: F.coalesce(F.sum(f"_{i}.non_null"), F.lit(0))
    counts = files.groupBy(by).agg(F.sum("_rows").alias("rowcount"), *(F.when(~unsure(i), filled(i)).alias(f"{c}_non_null") for i, c in enumerate(cols)))
    return counts.withColumns({f"{c}_coverage": F.round(F.col(f"{c}_non_null") / F.col("rowcount"), 3) for c in cols})
