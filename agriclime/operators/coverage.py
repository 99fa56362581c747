"""Which stations reported when, and a profile of the wind columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import mean_present, max_present, nan_to_null


def coverage_long(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(time keys, station, n): the coverage table in its scalable long form."""
    return rollup.groupBy(*keys, "station").agg(F.count(F.lit(1)).alias("n"))


def coverage_matrix(rollup: DataFrame, keys: Sequence[str], stations: Sequence[int]) -> DataFrame:
    """One row per time key, one column per listed station; null where it was silent."""
    return (
        rollup.groupBy(*keys).pivot("station", list(stations)).agg(F.count(F.lit(1)).alias("n"))
    )


def coverage_tiles(rollup: DataFrame, keys: Sequence[str], width: int = 100) -> DataFrame:
    """The coverage matrix of any number of stations, cut into tiles of ``width`` columns.

    A row holds one time key and one tile; column ``s<j>`` of tile ``t`` is station
    ``t * width + j``. The schema is fixed, and no row or plan grows with the
    number of stations. A tile in which nobody reported has no row.
    """
    cells = rollup.withColumns(
        {
            "tile": F.floor(F.col("station") / F.lit(width)).cast("int"),
            "slot": F.pmod(F.col("station"), F.lit(width)).cast("int"),
        }
    )
    wide = (
        cells.groupBy(*keys, "tile").pivot("slot", list(range(width))).agg(F.count(F.lit(1)))
    )
    return wide.withColumnsRenamed({str(j): f"s{j}" for j in range(width)})


def station_count(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stations reporting per time key: the row sum of the matrix, without building it."""
    return rollup.groupBy(*keys).agg(F.count("station").alias("station_num"))


def wind_profile(
    daily: DataFrame, cols: Sequence[str] = ("ws_avg",), count_col: str = "ws_avg",
    threshold: float = 9.0,
) -> DataFrame:
    """Mean and maximum of the wind columns and the rows above a threshold, in one pass.

    ``n_gt_or_null`` also counts rows without a value.
    """
    value = nan_to_null(count_col)
    stats = [
        stat
        for c in cols
        for stat in (mean_present(c).alias(f"{c}_mean"), max_present(c).alias(f"{c}_max"))
    ]
    return daily.agg(
        *stats,
        F.count_if(value > threshold).alias("n_gt"),
        F.count_if(F.coalesce(value > threshold, F.lit(True))).alias("n_gt_or_null"),
    )
