"""Joining a fact panel with its geography, weather and forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.schema import numeric_columns


def coalesce_station_time(df: DataFrame, keys: Sequence[str] = ("station_id", "Datetime"), order: Sequence[str] = ()) -> DataFrame:
    """One row a key: means of numbers, else the first non-null value; rows with a null key go.

    order: columns that say which row is first; without them it is the least value.
    """
    numbers = set(numeric_columns(df, keys))
    others = [c for c in df.columns if c not in keys]

    def one(c: str) -> Column:
        if c in numbers:
            return F.avg(c).alias(c)
        if not order:
            return F.min(c).alias(c)
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)

    present = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return present.groupBy(*keys).agg(*map(one, others)) if others else present.distinct()


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns (nulls first); equal ones by the whole row.

    An aggregate, so that rows of a key are merged before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.struct(*rest).alias("row"))).alias("last"))
    return last.select(*(F.col(c) if c in keys else F.col("last.row")[c].alias(c) for c in df.columns))


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def distinct_ids(df: DataFrame, column: str = "station_id") -> DataFrame:
    return df.select(column).distinct()


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ids of two one-column tables, each once."""
    return a.toDF("id").union(b.toDF("id")).where("id is not null").distinct()


def attach_geo(panel: DataFrame, stations: DataFrame | None = None, districts: DataFrame | None = None, cities: DataFrame | None = None) -> DataFrame:
    """Adds district_id and city_id along station -> district -> city; tables that are None are passed over.

    Dimensions have one row a key here, so the panel keeps its rows; Spark broadcasts them by size.
    """
    if stations is not None:
        panel = join_new_columns(panel, stations.dropDuplicates(["station_id"]), ["station_id"])
    if districts is not None and "district_id" in panel.columns:
        panel = join_new_columns(panel, districts.dropDuplicates(["district_id"]), ["district_id"])
    if cities is not None and "city_id" in panel.columns:
        panel = panel.join(cities.select("city_id").distinct(), "city_id", "left")
    return panel


def station_places(stations: DataFrame, districts: DataFrame | None = None) -> DataFrame:
    """One row a station with its district and, by it, its city: where panels join and from which their places come."""
    once = stations.dropDuplicates(["station_id"])
    return once if districts is None else join_new_columns(once, districts.dropDuplicates(["district_id"]), ["district_id"])


def join_new_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that adds only columns that left doesn't have."""
    new = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*keys, *new), list(keys), "left") if new else left


def split_by_membership(df: DataFrame, geo: str, districts: DataFrame, cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose geo id is a known district, and rows whose geo id is a known city; a row may be both."""
    inside = lambda ids: df.join(ids.toDF(geo).distinct(), geo, "left_semi")
    return inside(districts), inside(cities)


def geo_slice(df: DataFrame, places: DataFrame, span: DataFrame, geo: str, time: str, districts: str = "district_id", cities: str = "city_id") -> DataFrame:
    """Weather rows that a panel can use: of its places (district, city), within its time range.

    places may be the dimensions' and span the panel before any join, so that neither needs the
    panel twice. The range is a scalar subquery: it runs first and, where `time` is a column of a
    file, is pushed into its scan.
    """
    first, last = span_of(span, time)
    return of_places(df.where(F.col(time).between(first, last)), places, geo, districts, cities)


def span_of(df: DataFrame, time: str) -> tuple[Column, Column]:
    """The first and last time of df, as scalar subqueries; both come from one aggregate."""
    ends = time_range(df, time)
    return ends.select("min_time").scalar(), ends.select("max_time").scalar()


def of_places(df: DataFrame, places: DataFrame, geo: str, districts: str = "district_id", cities: str = "city_id") -> DataFrame:
    """Rows whose geo id is one of the places' districts or cities."""
    ids = places.select(F.explode(F.array(districts, cities)).alias(geo)).where(F.col(geo).isNotNull()).distinct()
    return df.join(ids, geo, "left_semi")


class Source(NamedTuple):
    """Rows (geo_id, time, ...) to look up, of districts and cities alike.

    Of several rows a place and time the last by `order` counts, without it the greatest.
    """

    rows: DataFrame
    measures: Sequence[str]
    order: Sequence[str] = ()


def lookup(source: Source, places: DataFrame, time: str = "Datetime") -> DataFrame:
    """(district_id, city_id, time, row): what each place takes from a source at each time.

    One aggregate keeps the last row of each geo id and time, whatever its grain; each place then
    gets its district's and its city's rows. A district with any row at all takes its own and
    never its city's, which a window over a place's times decides, so the source is read once.
    """
    pairs = places.select("district_id", "city_id").distinct()
    row = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(source.order)), F.struct(*source.measures).alias("row"))
    last = of_places(source.rows, pairs, "geo_id").groupBy("geo_id", time).agg(F.max(row)["row"].alias("row"))
    grains = F.array(*(F.struct(F.col(f"{of}_id").alias("geo_id"), F.lit(of == "district").alias("_own")) for of in ("district", "city")))
    reach = pairs.select("district_id", "city_id", F.inline(grains))
    owned = F.max("_own").over(Window.partitionBy("district_id", "city_id"))
    return last.join(reach, "geo_id").withColumn("_owned", owned).where("_own = _owned").select("district_id", "city_id", time, "row")


def join_places(panel: DataFrame, sources: Sequence[Source], places: DataFrame | None = None, time: str = "Datetime") -> DataFrame:
    """Adds the sources' measures by place (district_id, city_id) and time.

    All sources are joined by the same keys, so the panel is dealt out once, if at all. places
    are the panel's places, to be had from the dimensions; else they are taken from the panel.
    Measures that the panel or an earlier source has are left as they are.
    """
    places, keys = panel if places is None else places, ("district_id", "city_id", time)
    for s in sources:
        new = [m for m in s.measures if m not in panel.columns]
        if new:
            found = lookup(s._replace(measures=new), places, time)
            right = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col("row")[m].alias(m) for m in new))
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
            panel = panel.join(right, same, "left").drop(*(f"_{k}" for k in keys))
    return panel


def join_by_geo(panel: DataFrame, rows: DataFrame, measures: Sequence[str], places: DataFrame | None = None, time: str = "Datetime", order: Sequence[str] = ()) -> DataFrame:
    """Adds measures by (district, time), or by (city, time) for stations whose district has no rows at all; see join_places."""
    return join_places(panel, [Source(rows, measures, order)], places, time)


def join_by_hour(panel: DataFrame, weather: DataFrame, measures: Sequence[str], time: str = "Datetime", order: Sequence[str] = ()) -> DataFrame:
    """Adds measures by time alone, where there is no geography; the last row of an hour counts."""
    new = [m for m in measures if m not in panel.columns]
    once = latest_per_key(weather.select(time, *dict.fromkeys([*new, *order])), [time], order or new)
    return join_new_columns(panel, once.select(time, *new), [time])


def forecast_source(rows: DataFrame, measures: Sequence[str], issue: str = "time_forecast", issued_before: bool = False, time: str = "Datetime") -> Source:
    """A forecast for each place and hour, the latest issued one; with issued_before none issued after its hour."""
    return Source(rows.where(F.col(issue) <= F.col(time)) if issued_before else rows, measures, [issue])


def number_rows(df: DataFrame, by: str, order: Sequence[str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
