"""Daily station weather to month, ten-day and half-month rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import mean_present, sum_or_zero
from ..functions.states import final, make_states, merge_states

# Extra time key of each grain below year and month.
GRAINS = {"month": (), "tenday": ("ten_day",), "half": ("half",)}
PARTS_PER_MONTH = {"ten_day": 3, "half": 2}
REQUIRED_MEASURES = ("rad_avg", "hm_avg", "ss_dura")
# Measure, source column and statistic of every rollup.
ROLLUP_STATISTICS = (
    ("tm_avg", "tm_avg", "mean"),
    ("tm_min", "tm_min", "mean"),
    ("tm_max", "tm_max", "mean"),
    ("pr_sum", "pr_day", "sum"),
    ("hm_avg", "hm_avg", "mean"),
    ("ss_dura", "ss_dura_sum", "mean"),
    ("rad_avg", "rad_sum", "mean"),
)
# Half months and ten-days do not nest: their common grain is the pair.
STATE_KEYS = ("station", "year", "month", "half", "ten_day")
# Time keys of rollups of several grains; ``part`` numbers the half or ten-day, 0 is a month.
GRAIN_TIME = ("grain", "year", "month", "part")


def time_keys(grain: str) -> list[str]:
    return ["year", "month", *GRAINS[grain]]


def group_keys(grain: str) -> list[str]:
    return ["station", *time_keys(grain)]


def rollup_climate(daily: DataFrame, grain: str = "month") -> DataFrame:
    """One row per station and period: mean of the measures, total of the rain.

    A plain hash aggregate: rows are combined on the map side first, so a station
    with a large share of the data ships one row per period and task.
    """
    return daily.groupBy(*group_keys(grain)).agg(
        mean_present("tm_avg").alias("tm_avg"),
        mean_present("tm_min").alias("tm_min"),
        mean_present("tm_max").alias("tm_max"),
        sum_or_zero("pr_day").alias("pr_sum"),
        mean_present("hm_avg").alias("hm_avg"),
        mean_present("ss_dura_sum").alias("ss_dura"),
        mean_present("rad_sum").alias("rad_avg"),
    )


def climate_states(daily: DataFrame) -> DataFrame:
    """Sums and counts per station and common grain of all rollups: four rows a month at most."""
    return daily.groupBy(*STATE_KEYS).agg(*make_states((v, s) for _, v, s in ROLLUP_STATISTICS))


def merge_climate_states(states: DataFrame) -> DataFrame:
    """One state per station and common grain from the states of several deliveries."""
    return states.groupBy(*STATE_KEYS).agg(*merge_states((v, s) for _, v, s in ROLLUP_STATISTICS))


def grain_parts(grains: Sequence[str]) -> Column:
    """The (grain, part) pairs that a row with ``half`` and ``ten_day`` belongs to."""
    part = {"month": F.lit(0), "tenday": F.col("ten_day"), "half": F.col("half")}
    return F.array(*[F.struct(F.lit(g).alias("grain"), part[g].alias("part")) for g in grains])


def rollup_grains(states: DataFrame, grains: Sequence[str] = tuple(GRAINS)) -> DataFrame:
    """The rollups of several grains on top of each other, from :func:`climate_states`.

    Keys are ``station`` and ``GRAIN_TIME``; ``part`` is null where the day is unknown. Only
    states are repeated, once for each grain; the weather is not read again.
    """
    met = states.withColumn("at", F.explode(grain_parts(grains)))
    met = met.withColumns({"grain": F.col("at.grain"), "part": F.col("at.part")})
    return met.groupBy("station", *GRAIN_TIME).agg(
        *[final(var, stat).alias(name) for name, var, stat in ROLLUP_STATISTICS]
    )


def spread_part(df: DataFrame) -> DataFrame:
    """``part`` as the columns ``ten_day`` and ``half``, null for other grains."""
    at = df.columns.index("part")
    parts = [
        F.when(F.col("grain") == grain, F.col("part")).alias(name)
        for grain, names in GRAINS.items()
        for name in names
    ]
    return df.select(*df.columns[:at], *parts, *df.columns[at + 1 :])


def complete_groups(rollup: DataFrame, cols: Sequence[str] = REQUIRED_MEASURES) -> DataFrame:
    """Keep groups in which every required measure was present at least once."""
    return rollup.dropna(how="any", subset=list(cols))


def valid_keys(rollup: DataFrame, grain: str = "month") -> DataFrame:
    """Keep groups whose key is complete: the direct way to drop malformed rows."""
    return rollup.dropna(how="any", subset=group_keys(grain))


def tally(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count ``n`` per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def station_tally(daily: DataFrame) -> DataFrame:
    return tally(daily, ["station"])


def tenday_tally(daily: DataFrame) -> DataFrame:
    return tally(daily, ["tenday_no", "month", "ten_day"])
