"""Headers, projections and the choice of model columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import finite

#: Accepted headers of each canonical column, the first that is there wins (fixed values).
AIR_ALIASES = {
    "station_id": ["Station ID", "station_id", "station", "STATION_ID"],
    "Datetime": ["Time", "Datetime", "time", "timestamp", "TIME"],
    "PM25_Concentration": ["PM25_Concentration", "PM2.5", "PM25", "pm25", "pm2_5", "pm2.5", "pm25_concentration"],
    "PM10_Concentration": ["PM10_Concentration", "PM10", "pm10", "pm10_concentration"],
    "NO2_Concentration": ["NO2_Concentration", "NO2", "no2", "no2_concentration"],
    "CO_Concentration": ["CO_Concentration", "CO", "co", "co_concentration"],
    "O3_Concentration": ["O3_Concentration", "O3", "o3", "o3_concentration"],
    "SO2_Concentration": ["SO2_Concentration", "SO2", "so2_concentration"],
}
STATION_ALIASES = {"station_id": ["Station ID", "station_id", "station"], "district_id": ["District ID", "district_id", "district"]}
DISTRICT_ALIASES = {"district_id": ["District ID", "district_id", "district"], "city_id": ["City ID", "city_id", "city"]}
CITY_ALIASES = {"city_id": ["City ID", "city_id", "city"]}
MET_ALIASES = {
    "geo_id": ["ID", "geo_id", "id"],
    "Datetime": ["Time", "Datetime", "time", "timestamp"],
    "weather": ["Weather", "weather"],
    "temperature": ["Temperature", "Temp", "AT", "temperature", "temp"],
    "pressure": ["Pressure", "pressure", "press"],
    "humidity": ["Humidity", "RH", "humidity", "rh"],
    "wind_speed": ["Wind Speed", "WIND_SPEED", "WindSpeed", "wind_speed", "ws"],
    "wind_direction": ["Wind Direction", "WIND_DIREC", "WindDirection", "wind_direction", "wd"],
}
FORECAST_ALIASES = {
    "geo_id": ["ID", "geo_id", "id"],
    "time_forecast": ["Forecast Time", "ForecastTime", "time_forecast", "ftime"],
    "Datetime": ["Future Time", "FutureTime", "time_future", "future_time"],
    "weather": ["Weather", "weather"],
    "up_temperature": ["Up temperature", "UpTemperature", "up_temperature", "temp_high_c", "temp_hi"],
    "bottom_temperature": ["Bottom Temperature", "BottomTemperature", "bottom_temperature", "temp_low_c", "temp_lo"],
    "wind_level": ["Wind Level", "WindLevel", "wind_level"],
    "wind_direction": ["Wind Direction", "WIND_DIREC", "wind_direction", "WindDirection"],
}


def resolve(columns: Sequence[str], accepted: Iterable[str], ignore_case: bool = False) -> str | None:
    """The first accepted header that is among the columns."""
    if not ignore_case:
        return next((a for a in accepted if a in columns), None)
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[a.lower()] for a in accepted if a.lower() in lower), None)


def canonicalize(df: DataFrame, aliases: Mapping[str, Iterable[str]], ignore_case: bool = False, keep_others: bool = True) -> DataFrame:
    """Renames each aliased column that is there to its canonical name.

    Other columns stay unless one would clash with a canonical name.
    """
    found = {canon: src for canon, names in aliases.items() if (src := resolve(df.columns, names, ignore_case))}
    others = [c for c in df.columns if keep_others and c not in found.values() and c not in found]
    return df.select(*(F.col(f"`{src}`").alias(canon) for canon, src in found.items()), *(F.col(f"`{c}`") for c in others))


def future_time(df: DataFrame, configured: str | None, accepted: Iterable[str]) -> str:
    """The column of a forecast's target hour: the configured one, else by alias, else Datetime."""
    if configured and configured in df.columns:
        return configured
    return resolve(df.columns, accepted) or "Datetime"


def base_projection(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    """Keys, target and those of the features that exist, each once."""
    wanted = [c for c in dict.fromkeys([*keys, target, *features]) if c in df.columns]
    return df.select(*wanted)


def drop_features(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Without the named columns; names that don't exist are ignored."""
    return df.drop(*([names] if isinstance(names, str) else names))


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    out = set(exclude)
    return [c for c, kind in df.dtypes if kind.startswith(NUMERIC) and c not in out]


def is_identifier(column: str) -> bool:
    return column.lower() in ("id", "station") or column.lower().endswith("_id")


def feature_lock(df: DataFrame, columns: Sequence[str], exclude: Iterable[str] = (), split: str = "split") -> DataFrame:
    """(pos, column): columns with a finite value in every split, in the given order.

    Excluded columns and ids (by name) are left out. One pass: finite values are counted for each split and column, then turned into rows.
    """
    kept = [c for c in columns if c not in set(exclude) and not is_identifier(c)]
    counts = df.groupBy(split).agg(*(F.count_if(finite(F.col(c))).alias(c) for c in kept))
    lines = counts.select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in kept))).alias("at", "cell"))
    good = lines.groupBy("at", "cell.column").agg(F.min("cell.n").alias("least")).where("least > 0").select("at", "column")
    # one row a column of the table
    return good.agg(F.array_sort(F.collect_list(F.struct("at", "column"))).alias("all")).select(F.posexplode("all").alias("pos", "cell")).select(
        F.col("pos").cast("long").alias("pos"), F.col("cell.column").alias("column")
    )
