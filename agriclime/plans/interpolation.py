"""Daily station weather to interpolated region weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import in_years
from ..operators.clean import region_coordinates
from ..operators.history import interpolate_as_of, moving_neighbours
from ..operators.interpolate import interpolate, region_grid, region_grid_grains, weather_of_neighbours
from ..operators.rollup import (
    GRAIN_TIME,
    GRAINS,
    climate_states,
    complete_groups,
    rollup_climate,
    rollup_grains,
    spread_part,
)
from ..operators.spatial import NEIGHBOURS, nearest_stations
from ..sources.tables import materialize


def neighbour_table(
    regions: DataFrame, stations: DataFrame, k: int = NEIGHBOURS
) -> DataFrame:
    """The ``k`` nearest stations of every region as a stage table."""
    return materialize(nearest_stations(regions, stations, k), "neighbours")


def interpolate_region_climate(
    daily: DataFrame,
    regions: DataFrame,
    stations: DataFrame,
    first_year: int,
    last_year: int,
    grain: str = "month",
    k: int = NEIGHBOURS,
    pairing: str = "aligned",
    neighbours: DataFrame | None = None,
    geo: DataFrame | None = None,
    moves: bool = False,
) -> DataFrame:
    """Region x period weather for the given years; ``daily`` carries calendar parts.

    ``regions`` has coordinates, or is the region list and ``geo`` the coordinate table
    (joined by ``region_coordinates``, which raises on double rows). Regions without
    coordinates keep their rows, without values. ``stations`` may hold station history.

    The neighbour list is a stage table of ``k`` rows per region. Weather of all other
    stations is dropped before the rollup, whose shuffle then grows with the neighbours,
    not with all stations. Several grains can share one list by passing the
    ``neighbours`` stage table.

    Of a station's history the latest entry counts for all years. With ``moves`` each period
    takes the places that hold on its first day (``neighbours``, if given, then come from
    ``history.moving_neighbours``).
    """
    if geo is not None:
        regions = materialize(region_coordinates(regions, geo), "regions")
    if neighbours is None:
        neighbours = (moving_neighbours if moves else neighbour_table)(regions, stations, k)
    wanted = weather_of_neighbours(in_years(daily, first_year, last_year), neighbours)
    rollup = complete_groups(rollup_climate(wanted, grain))
    grid = region_grid(regions, first_year, last_year, grain)
    return (interpolate_as_of if moves else interpolate)(neighbours, rollup, grid, grain, pairing=pairing)


def interpolate_region_climate_grains(
    daily: DataFrame,
    regions: DataFrame,
    stations: DataFrame,
    years: tuple[int, int] | None = None,
    grains: Sequence[str] = tuple(GRAINS),
    k: int = NEIGHBOURS,
    pairing: str = "aligned",
    neighbours: DataFrame | None = None,
    geo: DataFrame | None = None,
) -> DataFrame:
    """Region weather of several grains on top of each other: ``grain``, year, month, ten_day,
    half (null for other grains) and the measures.

    One scan of the weather makes the states of all stations, a stage table of at most four
    rows per station and month; grains, the range of years (if ``years`` is not given, that
    of the weather) and the neighbours' share are all taken from it. One neighbour table
    serves all grains.
    """
    if geo is not None:
        regions = materialize(region_coordinates(regions, geo), "regions")
    if neighbours is None:
        neighbours = neighbour_table(regions, stations, k)
    if years is not None:
        daily = in_years(daily, *years)
    states = materialize(climate_states(daily), "climate-states")
    if years is None:
        years = tuple(states.agg(F.min("year"), F.max("year")).first())
    wanted = weather_of_neighbours(states, neighbours)
    rolled = complete_groups(rollup_grains(wanted, grains))
    known = years[0] is not None  # no weather, no periods
    grid = region_grid_grains(regions, *(years if known else (1, 1)), grains).where(F.lit(known))
    return spread_part(interpolate(neighbours, rolled, grid, pairing=pairing, time=GRAIN_TIME))
