"""Checked CSV files, stored panels and footers, with the edges that the driver's tables don't have."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aeolis.operators import features
from aeolis.plans import panel_queries
from aeolis.sources import footers, quarantine, stored, tables

TYPES = {"id": "id", "t": "timestamp", "v": "double"}


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def checked(spark, path, lines, **more):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, bad = quarantine.read_checked(spark, str(path), TYPES, ["id", "t"], **more)
    return sorted(map(tuple, good.collect()), key=str), sorted((r.line, tuple(r.reasons), r.raw) for r in bad.collect())


def test_bad_rows_are_kept_with_line_and_reason(spark, tmp_path):
    lines = [
        "id,t,v,note",
        "1.0,2024-01-01 00:00:00,2.5,a",
        "",
        "2,soon,x,b",
        "3,2024-01-01 01:00:00,NaN,",
        ",2024-01-01 01:00:00,1,c",
        "id,t,v,note",
        "4,2024-01-01 01:00:00",
        '5,2024-01-01 02:00:00,-1e3,"a, b"',
        "6,2024-01-01 02:00:00,1,d,e",
    ]
    good, bad = checked(spark, tmp_path / "a.csv", lines)
    assert good == [("1", at(0), 2.5, "a"), ("3", at(1), None, None), ("5", at(2), -1000.0, "a, b")]
    assert bad == [
        (4, ("t: not a time", "v: not a number"), lines[3]),
        (6, ("id: missing",), lines[5]),
        (8, ("not 4 fields",), lines[7]),
        (10, ("not 4 fields",), lines[9]),
    ]


def test_mark_and_returns_at_the_ends_of_lines(spark, tmp_path):
    good, bad = checked(spark, tmp_path / "a.csv", ["﻿id;t;v\r", "1;2024-01-01 00:00:00;2\r", "2;2024-01-01 00:00:00;z\r"], own={"sep": ";"})
    assert good == [("1", at(0), 2.0)] and bad == [(3, ("v: not a number",), "2;2024-01-01 00:00:00;z")]


def test_lines_count_over_splits_of_a_file(spark, tmp_path):
    lines = ["id,t,v"] + [f"{i},2024-01-01 00:00:00,{'x' if i % 97 == 0 else i}" for i in range(1, 4000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        good, bad = checked(spark, tmp_path / "a.csv", lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [b[0] for b in bad] == [i + 1 for i in range(1, 4000) if i % 97 == 0]
    assert len(good) + len(bad) == 3999


def test_empty_and_wrong_sources(spark, tmp_path):
    assert checked(spark, tmp_path / "a.csv", ["id,t,v"]) == ([], [])
    with pytest.raises(ValueError, match="no column w"):
        quarantine.read_checked(spark, str(tmp_path / "a.csv"), {"w": "double"})
    with pytest.raises(ValueError, match="no such type"):
        quarantine.read_checked(spark, str(tmp_path / "a.csv"), {"v": "number"})
    with pytest.raises(ValueError, match="one line"):
        quarantine.read_checked(spark, str(tmp_path / "a.csv"), TYPES, own={"multiLine": "true"})
    good, status, bad = quarantine.ingest_checked(spark, {"none": None})
    assert good == {} and [tuple(r) for r in status.collect()] == [("none", "skipped", None, None)] and bad.isEmpty()


def test_reasons_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t,v\n1,soon,x\n2,soon,1\n")
    _, status, bad = quarantine.ingest_checked(spark, {"air": {"path": str(tmp_path / "a.csv"), "types": TYPES}})
    assert [tuple(r) for r in status.collect()] == [("air", "read", 0, 2)]
    assert sorted(map(tuple, quarantine.bad_by_reason(bad).collect())) == [("air", "t: not a time", 2), ("air", "v: not a number", 1)]


def panel(spark, rows):
    return spark.createDataFrame(rows, "station_id string, Datetime timestamp_ntz, y double")


@pytest.fixture
def kept(spark, tmp_path):
    path, name = str(tmp_path / "p"), "t_" + tmp_path.name.replace("-", "_")
    stored.create(panel(spark, [(s, at(h), float(h)) for s in ("a", "b", "c") for h in range(5)] + [(None, at(0), 7.0)]), name, path, buckets=4)
    yield name, path
    spark.sql(f"drop table if exists {name}")


def sums(spark, name, path):
    return {r[0]: (r[1], r[2]) for r in stored.read(spark, name, path).groupBy("station_id").agg(F.count("*"), F.sum("y")).collect()}


def test_stations_are_replaced_whole(spark, kept):
    name, path = kept
    assert sums(spark, name, path) == {"a": (5, 10.0), "b": (5, 10.0), "c": (5, 10.0), None: (1, 7.0)}
    new = panel(spark, [("b", at(0), 1.0), ("d", at(0), 4.0)])
    assert stored.replace(new, name, path, buckets=4) == 1
    want = {"a": (5, 10.0), "b": (1, 1.0), "c": (5, 10.0), "d": (1, 4.0), None: (1, 7.0)}
    assert sums(spark, name, path) == want
    stored.replace(new, name, path, buckets=4)
    assert sums(spark, name, path) == want
    with pytest.raises(ValueError, match="already"):
        stored.create(new, name, path)


def test_an_interrupted_replacement_isnt_seen(spark, kept, monkeypatch):
    name, path = kept
    before = sums(spark, name, path)
    with monkeypatch.context() as m:
        m.setattr(stored, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            stored.replace(panel(spark, [("a", at(0), 99.0)]), name, path, buckets=4)
    assert sums(spark, name, path) == before
    assert stored.replace(panel(spark, [("c", at(0), 1.0)]), name, path, buckets=4) == 2
    assert sums(spark, name, path) == before | {"c": (1, 1.0)}


def test_no_shuffle_on_stored_panels(spark, kept):
    name, path = kept
    stored.replace(panel(spark, [("b", at(0), 1.0)]), name, path, buckets=4)
    now = stored.read(spark, name, path)
    for df in (features.lags(now, "y", (1,), ("Datetime",)), now.groupBy("station_id").agg(F.sum("y"))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_compacted_is_the_same(spark, kept, tmp_path):
    name, path = kept
    stored.replace(panel(spark, [("b", at(0), 1.0)]), name, path, buckets=4)
    stored.compact(spark, name, path, name + "_2", str(tmp_path / "q"), buckets=2)
    assert sums(spark, name + "_2", str(tmp_path / "q")) == sums(spark, name, path)
    spark.sql(f"drop table {name}_2")


def test_a_long_station_is_stored_by_the_month(spark, tmp_path):
    name, path, keys = "by_month", str(tmp_path / "p"), ("station_id", "month")
    rows = panel(spark, [("a", at(24 * d), 1.0) for d in range(60)]).withColumn("month", F.date_format("Datetime", "yyyy-MM"))
    stored.create(rows, name, path, keys, buckets=4)
    stored.replace(rows.where("month = '2024-02'").limit(3), name, path, keys, buckets=4)
    got = stored.read(spark, name, path, keys).groupBy(*keys).count().collect()
    assert sorted(map(tuple, got)) == [("a", "2024-01", 31), ("a", "2024-02", 3)]
    spark.sql(f"drop table {name}")


def test_footers_of_files_with_other_columns(spark, tmp_path):
    path = str(tmp_path / "a b")
    rows = spark.createDataFrame([("1", 1.0, None), ("1", None, None), ("2", 3.0, [1])], "station_id string, y double, many array<int>")
    tables.write_panel(rows, path)
    spark.createDataFrame([("3", 5)], "station_id string, z int").write.mode("append").partitionBy("station_id").parquet(path)
    found = footers.footers(spark, path)
    audit = {r[0]: tuple(r[1:]) for r in footers.schema_audit(found, ["y", "w"]).collect()}
    assert audit == {"y": (True, False, True), "many": (True, False, False), "z": (True, False, False), "w": (False, False, True)}
    full = footers.coverage(found, ["y", "many"]).select("station_id", "rowcount", "y_non_null", "y_coverage", "many_non_null")
    assert sorted(map(tuple, full.collect())) == [("1", 2, 1, 0.5, None), ("2", 1, 1, 1.0, None), ("3", 1, 0, 0.0, 0)]


def test_footers_of_stations_with_odd_names(spark, tmp_path):
    names = ["a/b", "50% x", "é", "#1?"]
    tables.write_panel(spark.createDataFrame([(n, 1.0) for n in names], "station_id string, y double"), str(tmp_path / "p"))
    full = footers.coverage(footers.footers(spark, str(tmp_path / "p")), ["y"])
    assert sorted(map(tuple, full.collect())) == sorted((n, 1, 1, 1.0) for n in names)


def test_stations_share_directories(spark, tmp_path):
    """Their number follows the rows, not the stations; odd ids, nulls and a replaced panel come back as they were."""
    path, names = tmp_path / "p", ["a/b", "007", "é", None, *(f"s{i}" for i in range(400))]
    rows = [(n, i, None if i % 3 else float(i)) for n in names for i in range(2)]
    df = spark.createDataFrame(rows, "station_id string, i int, y double")
    tables.write_panel(df.limit(5), str(path), rows=1)
    tables.write_panel(df, str(path), rows=100)
    assert 1 < len(list(path.glob("*=*"))) <= 9 and len(list(path.rglob("*.parquet"))) <= 9
    got = tables.read_panel(spark, str(path))
    assert sorted(map(str, got.select("station_id", "i", "y").collect())) == sorted(map(str, df.collect())) and set(got.columns) == set(df.columns)


def test_round_trip_of_a_panel_takes_no_directory_a_station(spark, monkeypatch):
    made, write = [], tables.write_panel
    monkeypatch.setattr(tables, "write_panel", lambda df, path, *a, **k: (made.append(path), write(df, path, *a, **k))[1])
    out = panel_queries.QUERIES["roundtrip_panel"](spark, "/root/testdata/sf0.001")
    assert out.select("station_id").distinct().count() > 3
    assert len(list(Path(made[0]).glob("*=*"))) == 1
