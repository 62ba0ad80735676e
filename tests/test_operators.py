"""Small frames with the edges that the driver's tables don't have."""

import datetime as dt
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aeolis.functions import quantiles
from aeolis.functions.columns import finite, norm_id, parse_num, parse_ts
from aeolis.functions.schema import AIR_ALIASES, canonicalize, feature_lock
from aeolis.operators import distrib, enrich, features, forecast, impute, quality, scale, score, slices, split, windows
from aeolis.plans import panel_queries
from aeolis.plans import build
from aeolis.sources import tables


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def series(spark, values, station="a"):
    rows = [(station, at(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, Datetime timestamp_ntz, y double")


def column(df, c, order="Datetime"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]


def test_ids_times_numbers(spark):
    df = spark.createDataFrame([("1001.0", "x", "n/a"), (" 1001 ", "2024-01-01 05:00:00", "nan"), (None, None, "2.5")], "i string, t string, n string")
    got = df.select(norm_id(F.col("i")), parse_ts(F.col("t")), parse_num(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("1001", None, None), ("1001", at(5), None), (None, None, 2.5)]


def test_aliases_first_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`PM25` int, `PM2.5` int, x int")
    assert canonicalize(df, AIR_ALIASES).columns == ["PM25_Concentration", "PM25", "x"]
    assert canonicalize(df, {"x": ["PM25"]}, keep_others=False).collect() == [Row(x=1)]


def test_fill_from_the_past(spark):
    gap = [1.0, 3.0] + [None] * 40 + [9.0]
    df = series(spark, gap)
    assert column(impute.ffill(df, ["y"], 6), "y")[:10] == [1.0] + [3.0] * 7 + [None, None]
    full = column(impute.impute(df, ["y"], 6, 24), "y")
    assert None not in full and full[-1] == 9.0
    assert column(impute.impute(series(spark, [None, None]), ["y"]), "y") == [None, None]
    assert impute.impute(df.limit(0), ["y"]).count() == 0


def test_no_feature_looks_ahead(spark):
    a = series(spark, [float(i * i % 7) for i in range(30)])
    b = a.withColumn("y", F.when(F.col("Datetime") >= at(20), F.lit(1000.0)).otherwise(F.col("y")))

    def made(df):
        df = features.rolling(features.lags(df, "y", (1, 3)), ["y"], (3, 6), "past")
        return impute.impute(df, ["y_lag1h"]).where(F.col("Datetime") < at(20)).orderBy("Datetime").drop("y").collect()

    assert made(a) == made(b)


def test_rolling_definitions(spark):
    df = series(spark, [1.0, 2.0, None, 4.0])
    now, past = features.rolling(df, ["y"], (3,), "current"), features.rolling(df, ["y"], (3,), "past")
    assert column(now, "y_roll3h_mean") == [1.0, 1.5, 1.5, 3.0]
    assert column(now, "y_roll3h_std")[0] is None
    assert column(past, "y_roll3h_mean_past") == [None, 1.0, 1.5, 1.5]
    assert column(past, "y_roll3h_std_past")[1] == 0.0


def test_split_bounds_and_null_time(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(24)), ("a", at(25)), ("a", at(48)), ("a", at(49)), ("a", None)], "station_id string, Datetime timestamp_ntz")
    got = split.time_split(df, "2024-01-02", "2024-01-03")
    assert column(got, "split") == ["train", "train", "val", "val", "test"]
    assert all(r.ok for r in quality.split_check(got, "Datetime", "2024-01-02", "2024-01-03").collect())


@pytest.mark.parametrize("kind", scale.KINDS)
def test_scale_and_back(spark, kind):
    rows = [("a", float(i), 5.0, "train") for i in range(10)] + [("new", 3.0, 7.0, "test")]
    df = spark.createDataFrame(rows, "station_id string, y double, flat double, split string")
    params = scale.fit_scaler(df, ["y", "flat"], kind)
    scaled = scale.scale(df, params, ["y", "flat"])
    assert scaled.columns == df.columns
    assert scaled.where("station_id = 'a'").agg(F.max(F.abs("flat"))).first()[0] == 0.0
    back = scale.unscale(scaled, params, ["y", "flat"]).orderBy("station_id", "y").collect()
    for got, want in zip(back, df.orderBy("station_id", "y").collect(), strict=True):
        assert math.isclose(got.y, want.y, abs_tol=1e-6) and math.isclose(got.flat, want.flat, abs_tol=1e-6)


def test_windows_need_room(spark):
    short = series(spark, [1.0] * 5)
    assert windows.window_index(short, "y", ["y"], 5, (1,), 1, 0.0).count() == 0
    six = series(spark, [1.0, None, 3.0, 4.0, 5.0, 6.0])
    got = windows.window_index(six, "y", ["y"], 5, (1,), 1, 0.75)
    assert [tuple(r)[1:3] for r in got.collect()] == [(1, 0)]
    assert windows.window_index(six, "y", ["y"], 5, (1,), 1, 1.0).count() == 0
    x = windows.window_tensors(six, got, ["y"], 5, block=2).first().X
    assert x == [[1.0], [0.0], [3.0], [4.0], [5.0]]
    counts = windows.window_counts(series(spark, [1.0] * 10), 3, 1, 2).first()
    assert (counts.upper_bound, counts.exact) == (3, 4)


def test_tensors_over_block_borders(spark):
    df = series(spark, [float(i) for i in range(50)])
    index = windows.window_index(df, "y", ["y"], 7, (1,), 3)
    for r in windows.window_tensors(df, index, ["y"], 7, block=5).collect():
        assert [v for (v,) in r.X] == [float(r.start + k) for k in range(7)]


def test_geo_fallback_is_by_station(spark):
    panel = spark.createDataFrame([("a", at(0), "d1", "c1"), ("a", at(1), "d1", "c1"), ("b", at(0), "d2", "c1")], "station_id string, Datetime timestamp_ntz, district_id string, city_id string")
    d = spark.createDataFrame([("d1", at(0), 1.0), ("d1", at(0), 2.0)], "geo_id string, Datetime timestamp_ntz, t double")
    c = spark.createDataFrame([("c1", at(0), 10.0), ("c1", at(1), 11.0)], "geo_id string, Datetime timestamp_ntz, t double")
    got = {(r.station_id, r.Datetime): r.t for r in enrich.join_by_geo(panel, d.union(c), ["t"]).collect()}
    assert got == {("a", at(0)): 2.0, ("a", at(1)): None, ("b", at(0)): 10.0}


def test_geo_id_in_both_sets(spark):
    df = spark.createDataFrame([("x",), ("y",)], "geo_id string")
    both = df.where("geo_id = 'x'")
    d, c = enrich.split_by_membership(df, "geo_id", both, both)
    assert d.count() == c.count() == 1


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "station_id string, t int")
    assert tuple(quality.duplicate_report(df, ["station_id", "t"]).first()) == (4, 2, 1)
    assert tuple(quality.duplicate_report(df, ["none"]).first()) == (4, None, None)
    assert [tuple(r) for r in quality.duplicate_top(df, ["t"]).collect()] == [("a", 2)]
    assert tuple(quality.duplicate_report(df.limit(0), ["station_id"]).first()) == (0, 0, 0)


def test_feature_lock(spark):
    df = spark.createDataFrame([("train", 1.0, None, 2.0, 1), ("test", 1.0, 5.0, float("inf"), 1)], "split string, a double, b double, c double, geo_id int")
    assert [tuple(r) for r in feature_lock(df, ["c", "b", "geo_id", "a"]).collect()] == [(0, "a")]


def test_scores_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, float("nan"), 1.0), (1, 3.0, None), (2, None, None)], "horizon int, y_true double, y_pred double")
    got = {r.horizon: (r.n, r.rmse) for r in score.score(df).collect()}
    assert got == {1: (1, 1.0), 2: (0, None)}
    assert df.where(finite(F.col("y_true"))).count() == 2


def test_ridge_matches_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=200).cumsum()
    train, test = series(spark, y[:150].tolist()), series(spark, y[150:].tolist())
    got = forecast.ridge_direct(train, test, "y", 2, 3, alpha=1.0)

    def table(v):
        i = range(3, len(v) - 2)
        return np.array([[v[k - 1], v[k - 2], v[k - 3]] for k in i]), np.array([v[k + 2] for k in i])

    x, t = table(y[:150])
    mx, mt = x.mean(0), t.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + np.eye(3), (x - mx).T @ (t - mt))
    xt, tt = table(y[150:])
    want = sorted(zip(tt, mt + (xt - mx) @ w, strict=True))
    assert np.allclose(sorted((r.y_true, r.y_pred) for r in got.collect()), want, atol=1e-8)
    assert forecast.ridge_direct(train.limit(2), test, "y", 2, 3).count() == 0
    both = forecast.ridge_direct(train, test, "y", (1, 2), 3, alpha=1.0)
    assert {r.horizon for r in both.collect()} == {1, 2}
    alike = lambda df: sorted((r.station_id, round(r.y_true, 9), round(r.y_pred, 9)) for r in df.collect())
    assert alike(both.where("horizon = 2")) == alike(forecast.ridge_direct(train, test, "y", 2, 3, alpha=1.0))


def test_keep_list_comments(spark, tmp_path):
    (tmp_path / "keep.txt").write_text("# stations\n\n1001\n1002 # north\n")
    assert sorted(r[0] for r in tables.read_keep_list(spark, str(tmp_path / "keep.txt")).collect()) == ["1001", "1002"]
    (tmp_path / "none.txt").write_text("# nothing\n")
    with pytest.raises(ValueError, match="no station ids"):
        tables.read_keep_list(spark, str(tmp_path / "none.txt"))


def test_panel_round_trip_replaces(spark, tmp_path):
    path = str(tmp_path / "panel")
    tables.write_panel(series(spark, [1.0, 2.0]), path)
    tables.write_panel(series(spark, [3.0], "b"), path, files=2)
    assert [tuple(r) for r in tables.read_panel(spark, path).select("station_id", "y").collect()] == [("b", 3.0)]


def test_past_median_of_long_and_odd_stations(spark):
    """Against a plain median; ties, gaps at the start, runs of gaps, NaN, and rows without a station."""
    rng, rows = random.Random(4), []
    for station in ("a", "b", None):
        for i in range(400):
            y = None if rng.random() < 0.4 else float("nan") if rng.random() < 0.02 else float(rng.randint(-5, 5))
            rows.append((station, i, y, None if y is None else int(rng.random() * 9), "kept"))
    df = spark.createDataFrame(rows, "station_id string, Datetime long, y double, z int, note string").repartition(5)
    got = {(r.station_id, r.Datetime): r for r in impute.fill_past_median(df, ["y", "z"]).collect()}
    past = {}
    for station, i, y, z, _ in rows:
        for name, x in (("y", y), ("z", z)):
            seen = past.setdefault((station, name), [])
            want = x if x is not None else statistics.median(seen) if seen else None
            assert got[station, i][name] == want or x != x and got[station, i][name] != want
            if x is not None and x == x:
                seen.append(x)
    assert len(got) == len(rows) and all(r.note == "kept" for r in got.values())
    assert impute.fill_past_median(df.limit(0), ["y"]).count() == 0


def test_formats_and_merged_schemas(spark, tmp_path):
    """ORC there and back, a pruned scan, and station files with different columns."""
    df = spark.createDataFrame([("1", 1.5, None), ("2", None, "x")], "station_id string, y double, note string")
    tables.sink(df, f"{tmp_path}/t.orc", "orc")
    assert sorted(map(str, tables.read_table(spark, f"{tmp_path}/t.orc", "orc").collect())) == sorted(map(str, df.collect()))
    assert tables.read_table(spark, f"{tmp_path}/t.orc", "orc", columns=["y"]).columns == ["y"]
    df.select("y").write.parquet(f"{tmp_path}/m/station_id=1")
    df.select("note").write.parquet(f"{tmp_path}/m/station_id=2")
    merged = tables.read_panel(spark, f"{tmp_path}/m")
    assert set(merged.columns) == {"station_id", "y", "note"} and merged.count() == 4


def test_entry_without_the_training_data(monkeypatch):
    """A missing dependency leaves the panel queries alone."""
    plain = entry.importlib.import_module

    def missing(name):
        if name == "aeolis.llm.registry":
            raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
        return plain(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    if entry.importlib.util.find_spec("aeolis.llm"):
        with pytest.warns(UserWarning, match="ahocorasick"):
            assert set(entry.queries()) == set(panel_queries.QUERIES)


@pytest.mark.parametrize("limit", [0, 50, 1 << 20])
@pytest.mark.parametrize("n", [1, 2, 5, 12, 30_011])
def test_exact_percentiles_from_brackets(spark, n, limit):
    rng = np.random.default_rng(n)
    spread, tied = rng.lognormal(0, 3, n), rng.integers(0, 4, n).astype(float)
    tied[rng.random(n) < 0.4] = -7.5
    rows = [(float(a), float(b), None if i % 3 else float(a)) for i, (a, b) in enumerate(zip(spread, tied, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    points = (0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0)
    got = quantiles.quantiles(df, {c: F.col(c) for c in "abc"}, points, accuracy=200, whole=limit).first()
    for name, values in (("a", spread), ("b", tied), ("c", spread[::3])):
        assert got[name] == pytest.approx(np.quantile(values, points).tolist(), rel=1e-12), name


def test_percentiles_of_nothing_and_of_no_number(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 1.0), (None, 2.0)], "a double, b double")
    got = quantiles.quantiles(df, {"a": F.col("a"), "b": F.col("b")}, (0.5, 1.0)).first()
    assert got.a == [None, None] and got.b == [2.0, math.inf]
    assert quantiles.quantiles(df.limit(0), {"b": F.col("b")}, (0.5,)).first().b == [None]
    assert distrib.bin_range(df.limit(0), "b") == (-1.0, 1.0)


def test_build_reads_each_source_once(spark, tmp_path):
    """And air once more for its hours; no nested loop, and the panel meets places by equality."""
    rows = {
        "air": [("a.0", "2024-01-01 05:10:00", 1.0), ("a", "2024-01-01 05:50:00", 3.0), ("b", "2024-01-01 06:00:00", 5.0), ("c", "bad", 1.0)],
        "met": [("d1", "2024-01-01 05:00:00", 7.0), ("c1", "2024-01-01 05:00:00", 8.0), ("c1", "2024-01-01 06:30:00", 9.0), ("c1", "2024-01-02 06:00:00", 0.0), ("zz", "2024-01-01 05:00:00", 0.0)],
        "fore": [("c1", "2024-01-01 03:00:00", "2024-01-01 05:00:00", 1.0), ("c1", "2024-01-01 04:00:00", "2024-01-01 05:00:00", 2.0)],
        "sta": [("a", "d1"), ("b", "d2"), ("c", None)],
        "dis": [("d1", "c1"), ("d2", "c1")],
    }
    heads = {"air": "station string, Time string, `PM2.5` double", "met": "ID string, Time string, RH double", "fore": "ID string, ForecastTime string, FutureTime string, temp_hi double"}
    heads |= {"sta": "station_id string, district_id string", "dis": "district_id string, city_id string"}
    for name, made in rows.items():
        spark.createDataFrame(made, heads[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    t = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in rows}
    out = build.build_panel(t["air"], t["sta"], t["dis"], None, t["met"], t["fore"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    reads = {n: sum(f"{c}#" in s for s in scans) for n, c in (("met", "RH"), ("fore", "temp_hi"), ("air", "PM2.5"))}
    assert reads == {"met": 1, "fore": 1, "air": 1} and "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.station_id, r.Datetime.hour): (r.PM25_Concentration, r.humidity, r.up_temperature, r.city_id) for r in out.collect()}
    assert got == {("a", 5): (2.0, 7.0, 2.0, "c1"), ("b", 6): (5.0, 9.0, None, "c1")}
    early = build.build_panel(t["air"], t["sta"], t["dis"], None, None, t["fore"], issued_before=True).where("station_id = 'a'").first()
    assert early.up_temperature == 2.0


def one_hot_station(spark, n=3000, seed=1):
    """One station with a third of all rows, many small ones, gaps, and a null station."""
    rng = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else None if i % 97 == 0 else f"s{rng.randrange(40)}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, None if rng.random() < 0.3 else rng.random()) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "station_id string, Datetime timestamp_ntz, event_id long, y double").repartition(5)


@pytest.mark.parametrize("size", [7, 1000])
def test_slices_equal_whole_stations(spark, size):
    df, order = one_hot_station(spark), ["Datetime"]

    def made(df, by, order):
        df = impute.fill_past_mean(impute.ffill(df, ["y"], 2, order, by), ["y"], 5, order, by)
        return features.rolling(features.lag_matrix(df, "y", 3, order, by), ["y"], (4,), "past", order, by)

    whole = made(df, "station_id", order)
    cut = slices.by_slices(df, made, before=2 + 5 + 4, size=size)
    assert sorted(cut.columns) == sorted(whole.columns) and cut.count() == whole.count()
    key = lambda r: r.event_id
    for a, b in zip(sorted(whole.collect(), key=key), sorted(cut.select(whole.columns).collect(), key=key), strict=True):
        assert all(x == z or abs(x - z) < 1e-12 for x, z in zip(a, b, strict=True) if isinstance(x, float)) and [x is None for x in a] == [x is None for x in b]
    args = (df, "y", ["y"], 6, (1, 3), 2, 0.5)
    index = lambda size: sorted(map(str, windows.window_index(*args, size=size).collect()))
    assert index(size) == index(None) and len(index(size)) > 100


def test_no_task_holds_a_station(spark):
    """Of 3,000 rows 1,000 are one station's; ranges and slices keep pieces small."""
    numbered = slices.with_halo(slices.number_rows(one_hot_station(spark), parts=8, count="_n"), before=11, size=50)
    pieces = numbered.groupBy("station_id", "_slice").count()
    assert pieces.agg(F.max("count")).first()[0] <= 50 + 11
    hot = numbered.where("station_id = 'hot' and _own")
    assert [r._rn for r in hot.orderBy("Datetime").collect()] == list(range(1000)) and hot.select("_n").distinct().first()._n == 1000
    plan = slices.by_slices(one_hot_station(spark), lambda d, by, order: features.lags(d, "y", (1,), order, by), before=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(station_id#\d+, _slice", plan) and not re.search(r"hashpartitioning\(station_id#\d+, \d+\)", plan)


def test_windows_of_a_hot_station_by_ranges(spark):
    """Tensors, samples and ends are the same by ranges, null station too, and no task holds a station."""
    df = one_hot_station(spark)
    index = windows.window_index(df, "y", ["y"], 6, (1, 3), 2, 0.5, size=50)
    lines = lambda x: sorted(map(str, x.collect()))
    cut, whole = (windows.window_tensors(df, index, ["y"], 6, block=20, by_ranges=r) for r in (True, False))
    assert lines(cut) == lines(whole) and cut.count() == index.count() and cut.where("station_id is null").count() > 0
    sampled, at_once = (windows.subsample(index, 0.3, 2, "7", keys=["horizon"], by_ranges=r) for r in (True, False))
    assert lines(sampled) == lines(at_once) and 0 < sampled.count() < index.count()
    for made in (cut, sampled, windows.subsample_ends(index, 0.2), windows.subsample_ends(index, 0.2, order="time")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((station_id|_series)#\d+, \d+\)|SinglePartition", plan)
    one = index.where("horizon = 1")
    order = {"station": lambda r: (r.station_id is not None, r.station_id or "", r.start), "time": lambda r: (r.target_time, r.station_id is not None, r.station_id or "", r.start)}
    for name, key in order.items():
        want = sorted(one.collect(), key=key)
        k = math.ceil(0.2 * len(want))
        assert lines(windows.subsample_ends(one, 0.2, order=name)) == sorted(map(str, want[:k]))
        assert lines(windows.subsample_ends(one, 0.2, "tail", order=name)) == sorted(map(str, want[-k:]))


def test_ridge_long_lookback_in_one_pass(spark):
    """168 lags and six horizons from one aggregate, as NumPy fits them; values far from zero."""
    rng = np.random.default_rng(4)
    y = 1e6 + np.cumsum(rng.normal(size=1500))
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(y)], "station_id string, Datetime timestamp_ntz, y double")
    cut = dt.datetime(2024, 1, 1) + dt.timedelta(hours=1200)
    train, test = df.where(F.col("Datetime") < F.lit(cut)), df.where(F.col("Datetime") >= F.lit(cut))
    horizons = (1, 3, 6, 12, 24, 48)
    got = {}
    for r in forecast.ridge_direct(train, test, "y", horizons).collect():
        got.setdefault(r.horizon, []).append((r.y_true, r.y_pred))
    assert sorted(got) == list(horizons)

    def rows(v, h):
        at = range(168, len(v) - h)
        return np.array([v[i - 168 : i][::-1] for i in at]), np.array([v[i + h] for i in at])

    for h in horizons:
        (x, t), (x2, t2) = rows(y[:1200], h), rows(y[1200:], h)
        w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(168), (x - x.mean(0)).T @ (t - t.mean()))
        want = sorted(zip(t2, t.mean() + (x2 - x.mean(0)) @ w, strict=True))
        assert np.allclose(sorted(got[h]), want, atol=1e-5)


@pytest.mark.parametrize("block", [7, 64])
def test_past_median_in_blocks(spark, block):
    """Blocks of a few rows give what one pass over a station gives, with ties, NaN, drift and a null station."""
    rng = random.Random(block)
    rows = [r.asDict() for r in one_hot_station(spark, 1500, block).collect()]
    for r in rows:
        i = r["event_id"]
        r["y"] = None if r["y"] is None else float("nan") if rng.random() < 0.02 else float(round(r["y"] * 10) + (i // 100 if i % 2 else -(i // 50)))
        r["z"] = None if rng.random() < 0.9 else rng.random()
    df = spark.createDataFrame([Row(**r) for r in rows], "station_id string, Datetime timestamp_ntz, event_id long, y double, z double").repartition(4)
    whole, cut = (impute.fill_past_median(df, ["y", "z"], block=b).orderBy("event_id").collect() for b in (10_000, block))
    assert list(map(str, cut)) == list(map(str, whole))
    assert impute.fill_past_median(df.limit(0), ["y"], block=block).count() == 0


def test_kde_from_cells(spark):
    """Cells and their powers give what an exponential a value gives; far values and a flat split too."""
    rng = np.random.default_rng(2)
    groups = {"a": np.r_[rng.normal(size=3000), 1e9], "b": rng.normal(5, 0.01, 500), "flat": np.full(7, 2.0), "one": np.array([3.0])}
    df = spark.createDataFrame([(s, float(v)) for s, x in groups.items() for v in x] + [("a", float("nan")), ("a", None)], "split string, y double")
    for r in distrib.kde(df, "y").collect():
        x = groups[r.split]
        std = x.std(ddof=1) if len(x) > 1 else 0
        bw = 1.06 * std * len(x) ** -0.2 if std > 0 else 1.0
        want = np.exp(-0.5 * ((r.mid - x) / bw) ** 2).sum() / len(x) / (bw * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want, rel=1e-9, abs=1e-13 / bw), (r.split, r.bin)
