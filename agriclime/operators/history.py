"""Stations that move: the entry of a station's history that holds on a day.

A history entry holds from its ``date_start`` until the next one of the same station. Days are
ISO texts, which sort like dates. Of entries with one start the one that
:func:`clean.latest_station` would take counts; entries without a start hold from the
beginning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .interpolate import MEASURES, REGION, STATIONS_USED, idw_weighted_mean
from .rollup import time_keys
from .spatial import NEIGHBOURS, nearest_stations

# Entries a station may have; a site is its station's number and the entry's.
ENTRIES = 1 << 16
FOREVER = "9999-99-99"


def validity(stations: DataFrame) -> DataFrame:
    """History entries with ``valid_from``, ``valid_to`` (exclusive) and their number ``entry``."""
    rest = [c for c in stations.columns if c not in ("station", "date_start")]
    start = F.coalesce("date_start", F.lit(""))
    single = stations.where(F.col("station").isNotNull()).groupBy("station", start.alias("valid_from"))
    single = single.agg(F.max(F.struct(*rest)).alias("e")).select("station", "valid_from", "e.*")
    by_start = Window.partitionBy("station").orderBy("valid_from")
    return single.withColumns(
        {
            "valid_to": F.coalesce(F.lead("valid_from").over(by_start), F.lit(FOREVER)),
            "entry": F.row_number().over(by_start),
        }
    )


def station_join_as_of(
    daily: DataFrame,
    stations: DataFrame,
    columns: Sequence[str] = ("wide", "station_name", "region"),
    date: str = "date",
) -> DataFrame:
    """Attach the columns of the entry that holds on each row's day; null before the first one.

    One row per station carries its few entries in order, as a stage table whose exact size
    decides the join. A weather row meets one row, whatever the number of moves, and is not
    sorted or shuffled for it; rows without a date have no entry.
    """
    entries = F.array_sort(F.collect_list(F.struct("valid_from", *columns)))
    table = validity(stations).groupBy("station").agg(entries.alias("_entries"))
    kept = daily.drop(*columns)
    joined = kept.join(materialize(table, "station-entries"), "station", "left")
    holding = F.filter("_entries", lambda e: e["valid_from"] <= F.col(date))
    entry = F.get(holding, F.size(holding) - 1)
    return joined.select(*kept.columns, *[entry[c].alias(c) for c in columns])


def period_start(grain: str = "month") -> Column:
    """First day of a period, as text."""
    day = {
        "month": F.lit("01"),
        "tenday": F.element_at(F.array(*[F.lit(d) for d in ("01", "11", "21")]), F.col("ten_day")),
        "half": F.when(F.col("half") == 1, F.lit("15")).otherwise(F.lit("01")),
    }[grain]
    year, month = (F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("year", 4), ("month", 2)))
    return F.concat_ws("-", year, month, day)


def moving_neighbours(regions: DataFrame, stations: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest stations of every region, for every time in which they stay the same.

    Columns ``wide``, ``region``, ``valid_from``, ``valid_to``, ``rank``, ``station``, ``dist``;
    a stage table. All entries' places are searched at once. A region's list is as long as its
    times need: where one of them finds fewer than ``k`` stations in a list that is not yet
    complete, the lists are doubled. Breaks are those of a region's own list, so its rows stay
    in proportion to that list, not to all moves.
    """
    sites = validity(stations).withColumns(
        {"number": F.col("station"), "station": F.col("station").cast("long") * ENTRIES + F.col("entry")}
    )
    sites = materialize(sites.select("station", "number", "latitude", "longitude", "valid_from", "valid_to", "entry"), "sites")
    most = sites.agg(F.max("entry")).first()[0] or 1
    if most >= ENTRIES:
        raise ValueError(f"a station has {most} history entries, {ENTRIES - 1} at most are possible")
    length = k * min(most, 4)
    while True:
        near = nearest_stations(regions, sites.select("station", "latitude", "longitude"), length)
        near = near.join(sites.select("station", "number", "valid_from", "valid_to"), "station")
        # The lists are bounded by their length.
        listed = near.groupBy(*REGION).agg(
            F.array_sort(F.collect_list(F.struct("dist", "number", "valid_from", "valid_to"))).alias("near")
        )
        # A place also ends where its station moves out of the list.
        ends = F.filter(F.col("near.valid_to"), lambda e: e < FOREVER)
        breaks = F.array_sort(F.array_distinct(F.concat(F.col("near.valid_from"), ends)))
        times = listed.withColumn("breaks", breaks).select(
            *REGION, "near", "breaks", F.posexplode("breaks").alias("at", "valid_from")
        )
        holding = F.filter("near", lambda s: (s["valid_from"] <= F.col("valid_from")) & (F.col("valid_from") < s["valid_to"]))
        times = times.select(
            *REGION,
            "valid_from",
            F.coalesce(F.get("breaks", F.col("at") + 1), F.lit(FOREVER)).alias("valid_to"),
            F.slice(holding, 1, k).alias("found"),
            (F.size("near") >= length).alias("more"),
        )
        times = materialize(times, "neighbour-times")
        if not times.where((F.size("found") < k) & F.col("more")).limit(1).count():
            break
        length *= 2
    found = times.select(*REGION, "valid_from", "valid_to", F.posexplode("found").alias("rank", "s"))
    return materialize(
        found.select(
            *REGION, "valid_from", "valid_to", (F.col("rank") + 1).alias("rank"), F.col("s.number").alias("station"), "s.dist"
        ),
        "moving-neighbours",
    )


def interpolate_as_of(
    neighbours: DataFrame,
    rollup: DataFrame,
    grid: DataFrame,
    grain: str = "month",
    m: int = STATIONS_USED,
    pairing: str = "aligned",
) -> DataFrame:
    """Like :func:`interpolate.interpolate`, with the neighbours of :func:`moving_neighbours`
    that hold on the first day of each period."""
    time = time_keys(grain)
    keys = [*REGION, *time]
    rolled = rollup.select("station", *time, *MEASURES).withColumn("_start", period_start(grain))
    met = neighbours.join(rolled, "station").where(
        (F.col("valid_from") <= F.col("_start")) & (F.col("_start") < F.col("valid_to"))
    )
    order = Window.partitionBy(*keys).orderBy("dist", "station")
    chosen = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= m)
    return grid.join(idw_weighted_mean(chosen, keys, MEASURES, pairing), keys, "left")
