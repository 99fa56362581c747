"""Daily station weather and yields to the growth-period feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.calendar import calendar_parts, since_year, tenday_key
from ..operators.calendars import feature_table_calendars
from ..operators.clean import (
    PROVINCES,
    date_complete,
    fill_precip,
    safe_station,
    station_join,
)
from ..operators.phenology import (
    DEFAULT_KEYS,
    PeriodRule,
    classify_period,
    feature_table,
    feature_yield,
)


def region_daily(
    weather: DataFrame,
    stations: DataFrame,
    provinces: Sequence[str] = PROVINCES,
    years: tuple[int, int | None] | None = None,
) -> DataFrame:
    """Cleaned daily weather of the wanted provinces with ten-day keys.

    Of a station's history the latest entry counts. ``years`` limits the scan.
    """
    clean = date_complete(safe_station(fill_precip(calendar_parts(weather, years=years))))
    joined = station_join(clean, stations, one_per_station=True, provinces=provinces)
    return tenday_key(joined.drop("rad_sum"))


def period_features(
    daily: DataFrame,
    year_from: int,
    month: int,
    ten_day: int,
    rules: Sequence[PeriodRule] | None = None,
    literal_month5: bool = False,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """All period statistics of one transplant calendar."""
    recent = since_year(daily, year_from)
    return feature_table(
        classify_period(recent, month, ten_day, rules, literal_month5), keys=keys
    )


def period_features_with_yield(
    daily: DataFrame,
    yields: DataFrame,
    year_from: int,
    month: int,
    ten_day: int,
    keys: Sequence[str] = DEFAULT_KEYS,
    exclude_year: int | None = 2021,
    **options,
) -> DataFrame:
    features = period_features(daily, year_from, month, ten_day, keys=keys, **options)
    return feature_yield(features, yields, keys, exclude_year)


def calendar_features(
    daily: DataFrame,
    rules: DataFrame,
    year_from: int,
    keys: Sequence[str] = DEFAULT_KEYS,
    by: Sequence[str] = ("wide",),
) -> DataFrame:
    """All period statistics of many calendars (rows of ``rules``) in one pass."""
    return feature_table_calendars(since_year(daily, year_from), rules, keys=keys, by=by)


def calendar_features_with_yield(
    daily: DataFrame,
    yields: DataFrame,
    rules: DataFrame,
    year_from: int,
    keys: Sequence[str] = DEFAULT_KEYS,
    by: Sequence[str] = ("wide",),
    exclude_year: int | None = 2021,
) -> DataFrame:
    """The data sets of all calendars, keyed by ``calendar``, with the yields."""
    features = calendar_features(daily, rules, year_from, keys, by)
    return feature_yield(features, yields, keys, exclude_year)
