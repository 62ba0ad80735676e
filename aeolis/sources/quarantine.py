"""CSV files whose rows are checked: good ones typed, bad ones kept aside with file, line and reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import norm_id, parse_num, parse_ts
from .tables import scratch_dir

#: Texts that stand for a missing value, besides an empty field.
MISSING = ("NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None")
#: How a text becomes a value of a type, and what its reason says otherwise.
PARSERS = {"double": (parse_num, "not a number"), "timestamp": (parse_ts, "not a time"), "id": (norm_id, "not an id")}


def read_checked(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str],
    required: Sequence[str] = (),
    common: Mapping[str, Any] | None = None,
    own: Mapping[str, Any] | None = None,
    missing: Sequence[str] = MISSING,
) -> tuple[DataFrame, DataFrame]:
    """Typed rows of CSV files, and (file, line, reasons, raw) of rows that don't fit.

    types names columns of the header with "double", "timestamp" or "id"; others stay text. A row is
    bad that has more or fewer fields than the header, a value not of its column's type, or nothing
    in a required column. Empty fields and those in `missing` are nulls, not faults. All files share
    the header of the first one; blank lines are skipped, and so are lines that repeat the header.
    A row stands on one line, so that files can be split, and line ends are single bytes in their
    encoding. Lines count from 1, whatever the splits.

    The files are read once: rows go to the shared folder with the block they stand in and their
    place there; line numbers are sums of the lines of earlier blocks and reach bad rows only.
    """
    options = {k: str(v) for k, v in (dict(common or {}) | dict(own or {})).items()}
    if options.pop("header", "true").lower() != "true":
        raise ValueError("checked files have a header line")
    if options.pop("multiLine", "false").lower() == "true":
        raise ValueError("checked rows stand on one line")
    encoding = options.pop("encoding", "UTF-8")
    reader = spark.read.options(**options).option("encoding", encoding)
    names = [c.removeprefix("\ufeff") for c in reader.option("header", "true").csv(path).columns]
    top = reader.option("header", "false").csv(path).first()
    odd = [c for c in (*types, *required) if c not in names]
    if odd:
        raise ValueError(f"{path} has no column {', '.join(odd)}")
    unknown = sorted(set(types.values()) - set(PARSERS))
    if unknown:
        raise ValueError(f"no such type: {', '.join(unknown)}")

    lines = spark.read.text(path)
    place = {"_file": "_metadata.file_path", "_block": "_metadata.file_block_start"}
    raw = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), F.lit(encoding))
    raw = F.regexp_replace(raw, "^\ufeff|\r$", "")
    lines = lines.select(raw.alias("_raw"), *(F.col(c).alias(n) for n, c in place.items()), F.monotonically_increasing_id().alias("_id"))
    # Fields are numbered, so that names of any kind don't matter.
    fields = ", ".join(f"f{i} string" for i in range(len(names))) + ", odd string"
    parsed = lines.withColumn("_row", F.from_csv("_raw", fields, options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "odd"}))
    heading = F.lit(True)
    for i, field in enumerate(top or ()):
        heading = heading & F.col(f"_row.f{i}").eqNullSafe(F.lit(field and field.removeprefix("\ufeff")))

    def text(i: int) -> Column:
        field = F.col(f"_row.f{i}")
        return F.when((F.trim(field) != "") & ~F.trim(field).isin(list(missing)), field)

    values, reasons = [], [F.when(F.col("_row.odd").isNotNull(), F.lit(f"not {len(names)} fields"))]
    for i, n in enumerate(names):
        given = text(i)
        parse, fault = PARSERS.get(types.get(n, ""), (lambda c: c, ""))
        value = parse(given)
        values.append(value.alias(f"_v{i}"))
        if fault:
            reasons.append(F.when(given.isNotNull() & value.isNull(), F.lit(f"{n}: {fault}")))
        if n in required:
            reasons.append(F.when(given.isNull() & F.col("_row.odd").isNull(), F.lit(f"{n}: missing")))
    found = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    parsed = parsed.withColumn("_reasons", F.when(F.col("_row.odd").isNotNull(), F.slice(found, 1, 1)).otherwise(found))
    skip = (F.trim("_raw") == "") | heading
    kind = F.when(skip, "skip").when(F.size("_reasons") > 0, "bad").otherwise("good")
    kept = parsed.withColumn("_kind", kind).select(
        *place, "_id", "_kind", *values,
        F.when(F.col("_kind") == "bad", F.col("_raw")).alias("_raw"),
        F.when(F.col("_kind") == "bad", F.col("_reasons")).alias("_reasons"),
    )
    stored = scratch_dir(spark, "checked")
    kept.write.partitionBy("_kind").parquet(stored)

    rows = spark.read.schema(kept.schema).parquet(stored)
    good = rows.where("_kind = 'good'").select(*(F.col(f"_v{i}").alias(n) for i, n in enumerate(names)))
    blocks = rows.groupBy(*place).agg(F.count("*").alias("_n"), F.min("_id").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*place, "_from", before.alias("_before"))
    bad = rows.where("_kind = 'bad'").join(blocks, list(place))
    line = (F.col("_before") + F.col("_id") - F.col("_from") + 1).cast("long")
    return good, bad.select(F.col("_file").alias("file"), line.alias("line"), F.col("_reasons").alias("reasons"), F.col("_raw").alias("raw"))


def ingest_checked(
    spark: SparkSession, sources: Mapping[str, Any], common: Mapping[str, Any] | None = None
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Typed tables of several files, a table (key, status, rows, bad) and the bad rows (key, file, line, reasons, raw).

    An entry is a mapping with path, types, and maybe required, read (options) and name; one without
    a path is skipped and counted as null.
    """
    good, bad, status = {}, [], []
    for key, entry in sources.items():
        spec = dict(entry or {})
        if not spec.get("path"):
            status.append(spark.range(1).select(F.lit(key).alias("key"), F.lit("skipped").alias("status"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("bad")))
            continue
        rows, odd = read_checked(spark, spec["path"], spec.get("types", {}), spec.get("required", ()), common, spec.get("read"))
        good[spec.get("name", key)] = rows
        bad.append(odd.select(F.lit(key).alias("key"), "*"))
        n = rows.agg(F.count("*").alias("rows")).join(odd.agg(F.count("*").alias("bad")))  # one row each
        status.append(n.select(F.lit(key).alias("key"), F.lit("read").alias("status"), "rows", "bad"))
    return good, _all(spark, status, "key string, status string, rows long, bad long"), _all(spark, bad, "key string, file string, line long, reasons array<string>, raw string")


def _all(spark: SparkSession, parts: Sequence[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def bad_by_reason(bad: DataFrame) -> DataFrame:
    """(key, reason, rows) of quarantined rows; a row with two reasons counts for both."""
    return bad.select("key", F.explode("reasons").alias("reason")).groupBy("key", "reason").agg(F.count("*").alias("rows"))
