"""Interpolated region weather that is kept and brought up to date by late reports.

A store is a folder with four tables:

* ``states``: sums and counts per station and common grain, one partition per delivery and
  year. A delivery only adds partitions of its own, so writing it again changes nothing.
* ``neighbours``: the nearest stations of every region; read by station it says which regions
  a report touches.
* ``regions``: the grid's regions.
* ``climate``: the interpolated weather of all grains, one partition per year.

A late report of one station recomputes the months of the regions that have it among their
neighbours, and rewrites the years in which these months lie; nothing else is read or written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import in_years
from ..operators.interpolate import REGION, interpolate, month_parts, region_grid, weather_of_neighbours
from ..operators.rollup import GRAIN_TIME, GRAINS, climate_states, complete_groups, merge_climate_states, rollup_grains
from ..operators.spatial import NEIGHBOURS, nearest_stations
from ..sources.tables import materialize

FIRST_DELIVERY = "first"


def _write(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table of the store; of a partitioned one only the partitions that ``df`` holds.

    Rows are brought together by partition first and large partitions are split, so each has
    a few files. The overwrite mode is the writer's, no session setting.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return
    writer = df.hint("rebalance", *partition_by).write.option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{name}")


def read_climate(spark: SparkSession, folder: str) -> DataFrame:
    """The interpolated weather: ``wide``, ``region``, ``GRAIN_TIME`` and the measures."""
    found = spark.read.parquet(f"{folder}/climate")
    rest = [c for c in found.columns if c not in (*REGION, *GRAIN_TIME)]
    return found.select(*REGION, *GRAIN_TIME, *rest)


def _add_states(daily: DataFrame, folder: str, delivery: str) -> DataFrame:
    states = materialize(climate_states(daily), "delivery-states")
    _write(states.withColumn("delivery", F.lit(delivery)), folder, "states", ["delivery", "year"])
    return states


def _interpolated(states: DataFrame, neighbours: DataFrame, grid: DataFrame, grains, pairing: str) -> DataFrame:
    rolled = complete_groups(rollup_grains(merge_climate_states(states), grains))
    return interpolate(neighbours, rolled, month_parts(grid, grains), pairing=pairing, time=GRAIN_TIME)


def create_store(
    folder: str,
    daily: DataFrame,
    regions: DataFrame,
    stations: DataFrame,
    first_year: int,
    last_year: int,
    grains: Sequence[str] = tuple(GRAINS),
    k: int = NEIGHBOURS,
    pairing: str = "aligned",
) -> None:
    """Write a store from ``daily`` (with calendar parts) for these years.

    ``regions`` (wide, region, lat, lng) and ``stations`` are those of
    ``interpolate_region_climate``.
    """
    states = _add_states(in_years(daily, first_year, last_year), folder, FIRST_DELIVERY)
    _write(nearest_stations(regions, stations, k), folder, "neighbours")
    _write(regions.select(*REGION), folder, "regions")
    spark = daily.sparkSession
    neighbours = spark.read.parquet(f"{folder}/neighbours")
    grid = region_grid(spark.read.parquet(f"{folder}/regions"), first_year, last_year)
    climate = _interpolated(weather_of_neighbours(states, neighbours), neighbours, grid, grains, pairing)
    _write(climate, folder, "climate", ["year"])


def add_reports(
    folder: str,
    daily: DataFrame,
    delivery: str,
    grains: Sequence[str] = tuple(GRAINS),
    pairing: str = "aligned",
) -> DataFrame:
    """Add rows of weather that came later; returns the touched (wide, region, year, month).

    ``delivery`` names the rows: the same name written again replaces the delivery (within
    its years), so a failed call is simply repeated. Rows of years or stations that the store
    does not use touch nothing. ``grains`` and ``pairing`` are those of the store.
    """
    spark = daily.sparkSession
    if delivery == FIRST_DELIVERY:
        raise ValueError(f"{FIRST_DELIVERY!r} is the delivery that the store was made of")
    neighbours = spark.read.parquet(f"{folder}/neighbours")
    # The years are folder names: one row each.
    years = [r[0] for r in spark.read.parquet(f"{folder}/climate").select("year").distinct().collect()]
    late = _add_states(daily.where(F.col("year").isin(years)), folder, delivery)

    reported = late.select("station", "year", "month").distinct()
    touched = reported.join(neighbours.select(*REGION, "station"), "station").select(*REGION, "year", "month")
    touched = materialize(touched.where(F.col("month").between(1, 12)).distinct(), "touched")
    if not touched.limit(1).count():
        return touched

    changed = [r[0] for r in touched.select("year").distinct().collect()]
    near = neighbours.join(touched.select(*REGION).distinct(), REGION, "left_semi")
    near = materialize(near, "touched-neighbours")
    months = near.select(*REGION, "station").join(touched, REGION).select("station", "year", "month").distinct()
    months = materialize(months, "touched-months")
    # Year folders outside the changed ones are not opened.
    states = spark.read.parquet(f"{folder}/states").where(F.col("year").isin(changed)).drop("delivery")
    states = states.join(months, ["station", "year", "month"], "left_semi")
    new = _interpolated(states, near, touched, grains, pairing)
    kept = read_climate(spark, folder).where(F.col("year").isin(changed))
    kept = kept.join(touched, [*REGION, "year", "month"], "left_anti")
    # Stored first: the same folders are read and replaced.
    _write(materialize(kept.unionByName(new), "changed-climate"), folder, "climate", ["year"])
    return touched
