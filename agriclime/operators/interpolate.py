"""Region weather by inverse distance from the nearest stations that reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .rollup import GRAIN_TIME, GRAINS, PARTS_PER_MONTH, time_keys

MEASURES = ("tm_avg", "tm_min", "tm_max", "pr_sum", "hm_avg", "ss_dura")
STATIONS_USED = 3
REGION = ["wide", "region"]


def region_grid(
    regions: DataFrame, first_year: int, last_year: int, grain: str = "month"
) -> DataFrame:
    """Every region with every period of the years; each region row expands on its own."""
    grid = regions.select(
        *REGION, F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year")
    ).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    for part in time_keys(grain)[2:]:
        grid = grid.withColumn(part, F.explode(F.sequence(F.lit(1), F.lit(PARTS_PER_MONTH[part]))))
    return grid


def region_grid_grains(
    regions: DataFrame, first_year: int, last_year: int, grains: Sequence[str] = tuple(GRAINS)
) -> DataFrame:
    """The grids of several grains on top of each other, keyed by region and ``GRAIN_TIME``."""
    return month_parts(region_grid(regions, first_year, last_year), grains)


def month_parts(months: DataFrame, grains: Sequence[str] = tuple(GRAINS)) -> DataFrame:
    """The periods of several grains of each row of (wide, region, year, month)."""
    parts = [
        (grain, part)
        for grain in grains
        for part in (range(1, PARTS_PER_MONTH[GRAINS[grain][0]] + 1) if GRAINS[grain] else [0])
    ]
    at = F.array(*[F.struct(F.lit(g).alias("grain"), F.lit(p).alias("part")) for g, p in parts])
    grid = months.withColumn("at", F.explode(at))
    return grid.select(*REGION, F.col("at.grain").alias("grain"), "year", "month", F.col("at.part").alias("part"))


def weather_of_neighbours(daily: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Weather of the stations that are somebody's neighbour; ``neighbours`` is a stage table.

    The filter is exact for everything grouped by station. The distinct stations are a
    stage table, whose exact size decides how the semi join is done.
    """
    used = materialize(neighbours.select("station").distinct(), "used-stations")
    return daily.join(used, "station", "left_semi")


def nearest_reporting(
    neighbours: DataFrame,
    rollup: DataFrame,
    grain: str = "month",
    m: int = STATIONS_USED,
    time: Sequence[str] | None = None,
) -> DataFrame:
    """Of each region's neighbours, the ``m`` nearest with a row in the period.

    ``time`` names the time keys if they are not those of ``grain``.

    Since a station has one row per period, this equals widening the neighbour list
    step by step until ``m`` of them report. A region-period has at most as many
    candidates as the region has neighbours, so the ranking groups stay small. A
    station listed twice for a region counts once, at its least distance.
    """
    near = neighbours.groupBy(*REGION, "station").agg(F.min("dist").alias("dist"))
    time = list(time or time_keys(grain))
    keys = [*REGION, *time]
    order = Window.partitionBy(*keys).orderBy("dist", "station")
    return (
        near.join(rollup.select("station", *time, *MEASURES), "station")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= m)
    )


def _all_present(c: Column, value: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), value)


def idw_weighted_mean(
    chosen: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str] = MEASURES,
    pairing: str = "aligned",
) -> DataFrame:
    """Sum(v/d) / Sum(1/d) per key; null as soon as one chosen station lacks the value.

    ``aligned`` weighs each value by its own station's distance, and a station at
    distance 0 decides alone. ``station_order`` reproduces the historical pairing:
    values ordered by station number meet distances ordered by distance, and a
    distance of 0 has no result.
    """
    if pairing == "aligned":
        return _aligned(chosen, keys, measures)
    if pairing == "station_order":
        return _station_order(chosen, keys, measures)
    raise ValueError(f"unknown pairing {pairing!r}")


def _aligned(chosen: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    on_the_spot = F.col("dist") == 0
    inverse = F.lit(1.0) / F.nullif(F.col("dist"), F.lit(0.0))

    def mean(c: str) -> Column:
        value = F.col(c)
        exact = F.avg(F.when(on_the_spot, value))
        weighted = F.sum(value * inverse) / F.sum(inverse)
        return _all_present(value, F.when(F.count_if(on_the_spot) > 0, exact).otherwise(weighted))

    return chosen.groupBy(*keys).agg(*[mean(c).alias(c) for c in measures])


def _station_order(chosen: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    # At most m rows per key, so the two short lists are bounded.
    lists = chosen.groupBy(*keys).agg(
        F.sort_array(F.collect_list("dist")).alias("distances"),
        F.sort_array(F.collect_list(F.struct("station", *measures))).alias("values"),
    )
    paired = lists.select(*keys, F.explode(F.arrays_zip("distances", "values")).alias("pair"))
    inverse = F.lit(1.0) / F.nullif(F.col("pair.distances"), F.lit(0.0))
    no_zero = F.count_if(F.col("pair.distances") == 0) == 0

    def mean(c: str) -> Column:
        value = F.col(f"pair.values.{c}")
        return F.when(no_zero, _all_present(value, F.sum(value * inverse) / F.sum(inverse)))

    return paired.groupBy(*keys).agg(*[mean(c).alias(c) for c in measures])


def interpolate(
    neighbours: DataFrame,
    rollup: DataFrame,
    grid: DataFrame,
    grain: str = "month",
    m: int = STATIONS_USED,
    pairing: str = "aligned",
    time: Sequence[str] | None = None,
) -> DataFrame:
    """Fill a region-period grid; periods without any reporting neighbour stay null."""
    keys = [*REGION, *(time or time_keys(grain))]
    filled = idw_weighted_mean(nearest_reporting(neighbours, rollup, grain, m, time), keys, MEASURES,
                               pairing)
    return grid.join(filled, keys, "left")
