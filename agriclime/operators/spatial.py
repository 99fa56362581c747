"""Nearest stations of every region, without comparing all pairs.

Stations are first reduced to distinct places (keeping the ``k`` lowest station
numbers of each, more can never be needed), and the places are put on a grid, cut where the
places are, that is refined eightfold per axis and level, until no cell holds many. All
regions walk down the levels together. At each level a region knows, for its
candidate cells, how many places they hold and the least and greatest possible
distance. The cells of smallest greatest-distance that together hold ``k`` places
bound the answer; cells that start beyond that bound are dropped, the others are
refined. After the last level only a few places per region are left, whose true
distances are ranked. The result is exact, the rows per region stay in proportion
to ``k``, and a dense area is simply split finer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import nan_to_null
from .clean import one_row_per_station
from ..sources.tables import materialize

NEIGHBOURS = 10
BITS_PER_LEVEL = 3
# Quantiles at which each axis is cut, and the accuracy of their ranks (1 / n).
CUTS = 64
CUT_ACCURACY = 10_000
MAX_LEVELS = 7
# The grid is refined until its fullest cell holds at most this many places.
CELL_CAPACITY = 32
# Cells of the first three levels number at most 8**2, 8**4 and 8**6, whatever the
# data: the first travels as an array, the next two can be broadcast.
BROADCAST_LEVELS = 3

POINT = ["lat", "lng"]


def _distance(dlat: Column, dlng: Column) -> Column:
    return F.sqrt(dlat * dlat + dlng * dlng)


def _degrees(c: str, limit: float) -> Column:
    """A coordinate; null where it is missing, infinite or no degree of its axis."""
    value = nan_to_null(c)
    return F.when(F.abs(value) <= limit, value)


def located_regions(regions: DataFrame) -> DataFrame:
    """(wide, region, lat, lng) of regions with coordinates; a region with two rows is an error."""
    problem = F.raise_error(F.lit("more than one row for a region"))
    single = F.count(F.lit(1)) == 1
    one = regions.groupBy("wide", "region").agg(
        F.when(single, F.first(_degrees("lat", 90.0))).otherwise(problem.cast("double")).alias("lat"),
        F.when(single, F.first(_degrees("lng", 180.0))).otherwise(problem.cast("double")).alias("lng"),
    )
    return one.dropna(subset=POINT)


def station_places(stations: DataFrame, k: int) -> DataFrame:
    """Distinct station coordinates with their (at most ``k``) lowest station numbers."""
    located = one_row_per_station(stations).select(
        "station",
        _degrees("latitude", 90.0).alias("latitude"),
        _degrees("longitude", 180.0).alias("longitude"),
    ).dropna()
    order = Window.partitionBy("latitude", "longitude").orderBy("station")
    return (
        located.withColumn("ordinal", F.row_number().over(order))
        .where(F.col("ordinal") <= k)
        .groupBy("latitude", "longitude")
        .agg(
            F.min("station").alias("first_station"),
            F.sort_array(F.collect_list("station")).alias("members"),
        )
    )


class _Grid:
    """Cell numbers at every level, by cuts that follow the data.

    Each axis is cut at the quantiles of the places, evenly between two cuts. So a cell
    holds a share of the places whatever the distances: one far place costs no level, and
    a dense spot is cut as finely as its share asks for. Cells need no exactness: what is
    compared is the extent of the places in them.
    """

    bits = BITS_PER_LEVEL * MAX_LEVELS

    def __init__(self, places: int, lat: list[float], lng: list[float]):
        self.places = places
        self.axes = {"cell_y": ("latitude", sorted(set(lat))), "cell_x": ("longitude", sorted(set(lng)))}

    @staticmethod
    def of(places: DataFrame) -> _Grid | None:
        """The grid of these places, from one aggregation of bounded size; None without places."""
        shares = [i / CUTS for i in range(CUTS + 1)]
        found = places.agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("latitude", shares, CUT_ACCURACY).alias("lat"),
            F.percentile_approx("longitude", shares, CUT_ACCURACY).alias("lng"),
        ).first()
        return _Grid(found["n"], found["lat"], found["lng"]) if found["n"] else None

    def _fine(self, name: str) -> Column:
        """The finest cell number of an axis."""
        column, cuts = self.axes[name]
        c, last = F.col(column), (1 << self.bits) - 1
        if len(cuts) < 2:
            return c.cast("int") * 0
        listed = F.array(*[F.lit(x) for x in cuts])
        at = F.least(F.size(F.filter(listed, lambda x: x <= c)), F.lit(len(cuts) - 1))
        low, high = F.get(listed, at - 1), F.get(listed, at)
        inside = (at - 1 + (c - low) / (high - low)) / F.lit(float(len(cuts) - 1))
        return F.least(F.floor(inside * F.lit(float(last + 1))), F.lit(last)).cast("int")

    def located(self, places: DataFrame) -> DataFrame:
        """The places with their finest cells."""
        return places.withColumns({f"fine_{name}": self._fine(name) for name in self.axes})

    def place_cell(self, level: int) -> dict[str, Column]:
        return {
            name: F.shiftright(F.col(f"fine_{name}"), self.bits - BITS_PER_LEVEL * level) for name in self.axes
        }

    def levels_needed(self, places: DataFrame) -> int:
        """The first level whose fullest cell is small enough.

        A strip of level n holds about an eighth to the n-th of the places, so of a few
        places nothing is counted.
        """
        few = next((n for n in (1, 2) if self.places <= CELL_CAPACITY << (BITS_PER_LEVEL * n)), None)
        if few:
            return few
        finest = places.select(
            *[F.col(f"fine_{name}") for name in self.axes],
            F.explode(F.sequence(F.lit(1), F.lit(MAX_LEVELS))).alias("level"),
        )
        coarser = F.lit(self.bits) - F.lit(BITS_PER_LEVEL) * F.col("level")
        fullest = (
            finest.groupBy(
                "level",
                *[F.call_function("shiftright", F.col(f"fine_{name}"), coarser).alias(name) for name in self.axes],
            )
            .agg(F.count(F.lit(1)).alias("places"))
            .groupBy("level")
            .agg(F.max("places").alias("places"))
            .where(F.col("places") <= CELL_CAPACITY)
            .agg(F.min("level").alias("level"))
            .first()
        )
        return fullest["level"] or MAX_LEVELS

    def cells(self, places: DataFrame, level: int) -> DataFrame:
        """Occupied cells: their places and the extent of those places."""
        return (
            places.select("latitude", "longitude", *[c.alias(name) for name, c in self.place_cell(level).items()])
            .groupBy("cell_y", "cell_x")
            .agg(
                F.count(F.lit(1)).alias("places"),
                F.min("latitude").alias("lat_lo"),
                F.max("latitude").alias("lat_hi"),
                F.min("longitude").alias("lng_lo"),
                F.max("longitude").alias("lng_hi"),
            )
        )


def _closest_cells(candidates: DataFrame, k: int) -> DataFrame:
    """Per point, drop the cells that cannot hold any of its ``k`` nearest places."""
    lat, lng = F.col("lat"), F.col("lng")
    zero = F.lit(0.0)
    nearest = _distance(
        F.greatest(F.col("lat_lo") - lat, lat - F.col("lat_hi"), zero),
        F.greatest(F.col("lng_lo") - lng, lng - F.col("lng_hi"), zero),
    )
    farthest = _distance(
        F.greatest(F.abs(lat - F.col("lat_lo")), F.abs(lat - F.col("lat_hi"))),
        F.greatest(F.abs(lng - F.col("lng_lo")), F.abs(lng - F.col("lng_hi"))),
    )
    per_point = Window.partitionBy(*POINT)
    inward = per_point.orderBy("farthest").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    enough = F.when(F.col("through") >= k, F.col("farthest"))
    return (
        candidates.withColumns({"nearest": nearest, "farthest": farthest})
        .withColumn("through", F.sum("places").over(inward))
        .withColumn("bound", F.min(enough).over(per_point))
        # The factor covers rounding in the two bounds; it can only keep more cells.
        .where(F.col("bound").isNull() | (F.col("nearest") <= F.col("bound") * (1 + 1e-9)))
        .select(*POINT, "cell_y", "cell_x")
    )


def nearest_stations(
    regions: DataFrame, stations: DataFrame, k: int = NEIGHBOURS
) -> DataFrame:
    """(wide, region, rank, station, dist) of the ``k`` nearest stations per region.

    Distance is Euclidean in degrees; equal distances rank by station number.
    Regions or stations without coordinates take no part; coordinates beyond 90 and 180
    degrees count as missing. Of a station's history the latest entry counts; a region
    with two rows, or a station with two and no ``date_start``, is an error. Runs small jobs:
    the distinct places become a stage table, whose quantiles and fullest cells decide
    the cuts and the depth of the grid.
    """
    stored = materialize(station_places(stations, k), "places")
    located = located_regions(regions)
    grid = _Grid.of(stored)
    if grid is None:
        return located.select(
            "wide", "region", F.lit(0).alias("rank"), F.lit(0).alias("station"),
            F.lit(0.0).alias("dist"),
        ).limit(0)

    places = grid.located(stored)
    levels = grid.levels_needed(places)
    points = located.select(*POINT).distinct()

    top = grid.cells(places, 1)
    top_cells = top.agg(F.collect_list(F.struct(*top.columns))).scalar()
    candidates = points.withColumn("cell", F.explode(top_cells)).select(*POINT, "cell.*")
    candidates = _closest_cells(candidates, k)
    for level in range(2, levels + 1):
        cells = grid.cells(places, level).withColumns(
            {
                "parent_y": F.shiftright("cell_y", BITS_PER_LEVEL),
                "parent_x": F.shiftright("cell_x", BITS_PER_LEVEL),
            }
        )
        if level <= BROADCAST_LEVELS:
            cells = F.broadcast(cells)
        parents = candidates.select(
            *POINT, F.col("cell_y").alias("parent_y"), F.col("cell_x").alias("parent_x")
        )
        candidates = _closest_cells(parents.join(cells, ["parent_y", "parent_x"]), k)

    dist = _distance(F.col("latitude") - F.col("lat"), F.col("longitude") - F.col("lng"))
    by_place = Window.partitionBy(*POINT).orderBy("dist", "first_station")
    by_station = Window.partitionBy(*POINT).orderBy("dist", "station")
    ranked = (
        candidates.join(places.withColumns(grid.place_cell(levels)), ["cell_y", "cell_x"])
        .select(*POINT, "first_station", "members", dist.alias("dist"))
        .withColumn("place_rank", F.row_number().over(by_place))
        .where(F.col("place_rank") <= k)
        .select(*POINT, "dist", F.explode("members").alias("station"))
        .withColumn("rank", F.row_number().over(by_station))
        .where(F.col("rank") <= k)
    )
    return located.join(ranked, POINT).select("wide", "region", "rank", "station", "dist")


def neighbours_wide(neighbours: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """One row per region with st1..st<k> and dist1..dist<k>; null past the last neighbour."""
    ranks = list(range(1, k + 1))
    wide = (
        neighbours.groupBy("wide", "region")
        .pivot("rank", ranks)
        .agg(F.first("station").alias("st"), F.first("dist").alias("dist"))
    )
    renamed = wide.withColumnsRenamed(
        {f"{r}_{name}": f"{name}{r}" for r in ranks for name in ("st", "dist")}
    )
    return renamed.select(
        "wide", "region", *[f"st{r}" for r in ranks], *[f"dist{r}" for r in ranks]
    )
