"""From raw tables to the panel: one row a station and hour, with geography, weather and forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import floor_hour, norm_id, parse_ts
from ..functions.schema import AIR_ALIASES, FORECAST_ALIASES, MET_ALIASES, canonicalize, future_time
from ..operators import enrich, features


def _hour(c: Column, kind: str) -> Column:
    return floor_hour(c.cast("timestamp_ntz") if kind.startswith(("timestamp", "date")) else parse_ts(c))


def _in_hours(df: DataFrame, span: tuple[Column, Column], geo: bool) -> DataFrame:
    """Rows of the span's hours, with Datetime as the hour and, if geo, geo_id as text.

    Times of files are compared as they stand, so that the scan can skip what lies outside; what
    has to be parsed is parsed once a row, not once for each comparison.
    """
    kind = dict(df.dtypes)["Datetime"]
    if kind.startswith("timestamp"):
        df = df.where((F.col("Datetime") >= span[0]) & (F.col("Datetime") < span[1] + F.expr("interval 1 hour")))
    made = [_hour(F.col("Datetime"), kind).alias("Datetime")] + [norm_id(F.col("geo_id")).alias("geo_id")] * geo
    others = [c for c in df.columns if c != "Datetime" and not (geo and c == "geo_id")]
    # a generated row: filters on it stay above, where its columns are there
    return df.select(*others, F.inline(F.array(F.struct(*made)))).where(F.col("Datetime").between(*span))


def build_panel(
    air: DataFrame,
    stations: DataFrame | None = None,
    districts: DataFrame | None = None,
    cities: DataFrame | None = None,
    weather: DataFrame | None = None,
    forecast: DataFrame | None = None,
    keep: DataFrame | None = None,
    future: str | None = None,
    issued_before: bool = False,
    weather_order: Sequence[str] = (),
) -> DataFrame:
    """The coalesced panel of raw tables, whose headers are known by their aliases.

    air is the backbone; keep (station ids) limits it. Dimensions are canonical (see
    sources.tables.dimension). Weather and forecast rows of the panel's places and hours are
    looked up by district or else by city; tables without a place are joined by the hour. Of
    several rows a place and hour the last by weather_order (or by value) counts, of forecasts
    the latest issued one. future: the forecast's column of hours, if not by alias.

    cities adds nothing to a panel of one row a station and hour, and is taken for completeness.
    Air rows are coalesced before anything is joined to them, as all of it depends on station
    and hour alone. Places come from the dimensions and the range of hours from air, so each
    source is read once, and air once more for its range.
    """
    raw = canonicalize(air, AIR_ALIASES)
    raw = raw.withColumns({"station_id": norm_id(F.col("station_id")), "Datetime": _hour(F.col("Datetime"), dict(raw.dtypes)["Datetime"])})
    if keep is not None:
        raw = features.scope(raw, keep)
    panel = enrich.coalesce_station_time(raw)
    located = False
    if stations is not None:
        geo = enrich.station_places(stations, districts)
        located = {"district_id", "city_id"} <= {*geo.columns}
        panel = enrich.join_new_columns(panel, geo, ["station_id"])
    span, sources = enrich.span_of(raw, "Datetime"), []

    def add(rows: DataFrame, keys: Sequence[str], order: Sequence[str], by_place: bool) -> None:
        nonlocal panel
        rows, measures = _in_hours(rows, span, by_place), [c for c in rows.columns if c not in keys]
        if issued_before and "time_forecast" in keys and by_place:
            rows = rows.where(F.col("time_forecast") <= F.col("Datetime"))
        if by_place:
            sources.append(enrich.Source(rows, measures, order))
        else:
            panel = enrich.join_by_hour(panel, rows, measures, order=order)

    if weather is not None:
        met = canonicalize(weather, MET_ALIASES)
        add(met, ("geo_id", "Datetime"), weather_order, located and "geo_id" in met.columns)
    if forecast is not None:
        hours = future_time(forecast, future, FORECAST_ALIASES["Datetime"])
        coming = canonicalize(forecast.withColumnRenamed(hours, "Datetime"), {k: v for k, v in FORECAST_ALIASES.items() if k != "Datetime"})
        issued = "time_forecast" in coming.columns
        if issued:
            coming = coming.withColumn("time_forecast", parse_ts(F.col("time_forecast")))
        keys = ("geo_id", "Datetime", "time_forecast")
        add(coming, keys, ["time_forecast"] if issued else [], located and issued and "geo_id" in coming.columns)
    return enrich.join_places(panel, sources, geo if located else None)
