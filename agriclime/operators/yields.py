"""Yield tables: union, province names, trend and detrending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import nan_to_null
from .clean import exclude_matching

# Provinces abbreviated to their first two characters, and the
# pattern of the metropolitan areas.
TWO_CHARACTER_PROVINCES = ("경기도", "강원도", "제주도")
METROPOLITAN_PATTERN = "광역|특별"


def yield_union(*tables: DataFrame) -> DataFrame:
    """Bag union by column name; nothing is deduplicated."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def province_abbrev(name: Column | str = "wide") -> Column:
    """Two-character province name: first two characters, or first and third."""
    name = F.col(name) if isinstance(name, str) else name
    short = F.substring(name, 1, 2)
    skipping = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1))
    return F.when(name.isin(list(TWO_CHARACTER_PROVINCES)), short).otherwise(skipping)


def yield_trend(df: DataFrame, y: str = "prod_10a_kg", x: str = "year") -> DataFrame:
    """One row: intercept, slope, r2 and n of the straight line of yield over years."""
    yv, xv = nan_to_null(y), F.col(x).cast("double")
    return df.agg(
        F.regr_intercept(yv, xv).alias("intercept"),
        F.regr_slope(yv, xv).alias("slope"),
        F.regr_r2(yv, xv).alias("r2"),
        F.regr_count(yv, xv).alias("n"),
    )


def detrend(
    df: DataFrame,
    trend: DataFrame | tuple[float, float],
    y: str = "prod_10a_kg",
    x: str = "year",
) -> DataFrame:
    """Add prod_trend and prod_norm.

    ``trend`` is the one-row result of :func:`yield_trend`, used as a scalar
    subquery, or an (intercept, slope) pair.
    """
    if isinstance(trend, tuple):
        intercept, slope = (F.lit(float(v)) for v in trend)
    else:
        line = trend.select(F.struct("intercept", "slope")).scalar()
        intercept, slope = line.getField("intercept"), line.getField("slope")
    fitted = intercept + slope * F.col(x)
    return df.withColumn("prod_trend", fitted).withColumn(
        "prod_norm", F.col(y) - F.col("prod_trend")
    )


def normalized_yields(
    tables: list[DataFrame], trend: tuple[float, float] | None = None
) -> DataFrame:
    """United yields without metropolitan areas, provinces abbreviated, detrended.

    The trend is fitted on all rows, before anything is dropped.
    """
    united = yield_union(*tables)
    kept = exclude_matching(united, "wide", METROPOLITAN_PATTERN)
    named = kept.withColumn("wide", province_abbrev())
    return detrend(named, trend if trend is not None else yield_trend(united))
