"""Cleaning and joining of daily weather, station and region tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import matches, max_present, mean_present, nan_to_null, safe_int
from ..sources.tables import materialize

# The eight provinces kept.
PROVINCES = ("강원", "경기", "경남", "경북", "전남", "전북", "충남", "충북")
SUBTOTAL_PATTERN = "소계"

# The columns the interpolation needs from the daily table.
ROLLUP_COLUMNS = (
    "station", "date", "year", "month", "day", "half", "ten_day", "tm_avg", "tm_min", "tm_max",
    "pr_day", "hm_avg", "ss_dura_sum", "rad_sum",
)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def project_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by position from 1; a repeated position is taken once."""
    return df.select(*[df.columns[i - 1] for i in dict.fromkeys(positions)])


def drop_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Drop columns by position from 1."""
    return df.drop(*[df.columns[i - 1] for i in positions])


def placeholders(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """Add empty columns of a given type."""
    return df.withColumns({c: F.lit(None).cast(dtype) for c in columns})


def fill_precip(df: DataFrame, col: str = "pr_day") -> DataFrame:
    """A day without a rain record counts as a dry day."""
    return df.withColumn(col, F.coalesce(nan_to_null(col), F.lit(0.0)))


def safe_station(df: DataFrame) -> DataFrame:
    """Integer station numbers; rows whose station is no number are dropped."""
    return df.withColumn("station", safe_int("station")).where(F.col("station").isNotNull())


def date_complete(df: DataFrame, length: int = 10) -> DataFrame:
    """Rows whose date text is long enough to hold a day."""
    return df.where(F.char_length("date") >= length)


def in_provinces(df: DataFrame, names: Sequence[str] = PROVINCES) -> DataFrame:
    return df.where(F.col("wide").isin(list(names)))


def exclude_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Drop rows whose text matches; a missing text is kept."""
    return df.where(~matches(col, pattern))


def latest_station(stations: DataFrame) -> DataFrame:
    """One row per station: the history entry that started last."""
    rest = [c for c in stations.columns if c != "station"]
    ordering = F.struct("date_start", *[c for c in rest if c != "date_start"])
    latest = F.max_by(F.struct(*rest), ordering).alias("entry")
    return stations.groupBy("station").agg(latest).select("station", "entry.*").select(
        *stations.columns
    )


def one_row_per_station(stations: DataFrame) -> DataFrame:
    """The latest history entry of each station; without ``date_start`` a second row is an error."""
    if "date_start" in stations.columns:
        return latest_station(stations)
    rest = [c for c in stations.columns if c != "station"]
    problem = F.raise_error(F.lit("more than one row for a station")).cast("boolean")
    entry = F.first(F.struct(*rest)) if rest else F.lit(None)
    found = stations.groupBy("station").agg(
        entry.alias("entry"), F.when(F.count(F.lit(1)) > 1, problem).otherwise(True).alias("single")
    )
    found = found.where("single")
    return found.select("station", *[f"entry.{c}" for c in rest]).select(*stations.columns)


def station_join(
    daily: DataFrame,
    stations: DataFrame,
    one_per_station: bool = False,
    provinces: Sequence[str] | None = None,
) -> DataFrame:
    """Attach province, station name and region to every weather row.

    The four columns become a stage table first: its exact size lets the optimizer
    broadcast it up to the threshold, and beyond it both sides are shuffled and a hot
    station is split at run time. ``provinces`` keeps the rows of their stations only
    and is applied to the stations. With several history entries per station the join
    fans out unless ``one_per_station`` (``one_row_per_station``).
    """
    meta = one_row_per_station(stations) if one_per_station else stations
    meta = meta.select("station", "wide", "station_name", "region")
    if provinces is not None:
        meta = in_provinces(meta, provinces)
    return daily.join(materialize(meta, "station-names"), "station", "left" if provinces is None else "inner")


def region_coordinates(regions: DataFrame, geo: DataFrame) -> DataFrame:
    """Regions with their coordinates; raises if a region has two coordinate rows."""
    single = F.count(F.lit(1)) == 1
    problem = F.raise_error(F.lit("more than one coordinate row for a region"))
    unique = geo.groupBy("wide", "region").agg(
        F.when(single, F.first("lat")).otherwise(problem.cast("double")).alias("lat"),
        F.when(single, F.first("lng")).otherwise(problem.cast("double")).alias("lng"),
    )
    return regions.select("wide", "region").join(unique, ["wide", "region"], "left")


def region_day_mean(joined: DataFrame) -> DataFrame:
    """One row per date and region: means over its stations, and the strongest wind."""
    return joined.groupBy("date", "region", "wide").agg(
        *[
            mean_present(c).alias(c)
            for c in ("tm_avg", "tm_min", "tm_max", "pr_day", "hm_avg", "ss_dura_sum", "rad_sum")
        ],
        max_present("ws_avg").alias("ws_max"),
    )
