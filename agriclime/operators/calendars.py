"""Many growing calendars in one pass over the weather.

A calendar has its own transplant ten-day, periods and provinces; one row belongs to as many
calendars as its province has. Calendars become a small table with one row per (group,
ten-day) that lists all (calendar, period) pairs, so rows meet them by equality.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import TENDAYS_PER_YEAR, tenday_number
from ..functions.states import final, make_states
from ..sources.tables import materialize
from .phenology import DEFAULT_KEYS, FEATURE_SPECS, PERIOD_RULES, PERIODS, FeatureSpec, PeriodRule, feature_columns


@dataclass(frozen=True)
class GrowingCalendar:
    """Periods after the transplant ten-day (``month``, ``ten_day``), for these provinces."""

    name: str
    provinces: tuple[str, ...]
    month: int
    ten_day: int
    rules: tuple[PeriodRule, ...] | None = None

    def periods(self) -> tuple[PeriodRule, ...]:
        if self.rules is not None:
            return self.rules
        if self.month not in PERIOD_RULES:
            raise ValueError(f"no period rules for transplant month {self.month}: pass rules")
        return PERIOD_RULES[self.month]


# Period offsets of the two mountain calendars, and the six data sets by
# province group and transplant ten-day.
MOUNTAIN_EARLY = (
    PeriodRule("P1", 0, 0),
    PeriodRule("P2", 1, 6),
    PeriodRule("P3", 7, 9),
    PeriodRule("P4", 10, 12),
    PeriodRule("P5", 13, 14),
)
MOUNTAIN_LATE = (
    PeriodRule("P1", 0, 0),
    PeriodRule("P2", 1, 5),
    PeriodRule("P3", 6, 8),
    PeriodRule("P4", 9, 10),
    PeriodRule("P5", 11, 13),
)
RICE_CALENDARS = (
    GrowingCalendar("south_may", ("충남", "전북", "경남"), 5, 3),
    GrowingCalendar("south_june", ("충남", "전북", "경남"), 6, 1),
    GrowingCalendar("middle_may", ("경기", "충북", "전남", "경북"), 5, 3),
    GrowingCalendar("middle_june", ("경기", "충북", "전남", "경북"), 6, 1),
    GrowingCalendar("mountain_early", ("강원",), 5, 1, MOUNTAIN_EARLY),
    GrowingCalendar("mountain_late", ("강원",), 5, 2, MOUNTAIN_LATE),
)


def calendar_rules(spark: SparkSession, calendars: Sequence[GrowingCalendar]) -> DataFrame:
    """The calendars as rows: calendar, wide, month, ten_day, period, lo, hi."""
    rows = [
        (c.name, province, c.month, c.ten_day, r.period, r.lo, r.hi)
        for c in calendars
        for province in c.provinces
        for r in c.periods()
    ]
    return spark.createDataFrame(
        rows, "calendar string, wide string, month int, ten_day int, period string, lo int, hi int"
    )


def calendar_periods(rules: DataFrame, by: Sequence[str] = ("wide",)) -> DataFrame:
    """One row per (group, ten-day) with ``entries``, its (calendar, period) pairs, as a stage table.

    Within a calendar, overlapping periods go to the lowest ``lo``, then the period name. A
    null ``hi`` runs to the end of the year; ten-days of other years take no part.
    """
    start = tenday_number(F.col("month"), F.col("ten_day"))
    last_of_year = F.lit(TENDAYS_PER_YEAR)
    first = F.greatest(start + F.col("lo"), F.lit(1))
    last = F.least(start + F.coalesce(F.col("hi"), last_of_year), last_of_year)
    covered = (
        rules.withColumns({"first_no": first, "last_no": last})
        .where(F.col("first_no") <= F.col("last_no"))
        .withColumn("tenday_no", F.explode(F.sequence("first_no", "last_no")))
        .groupBy(*by, "tenday_no", "calendar")
        .agg(F.min_by("period", F.struct("lo", "period")).alias("period"))
    )
    # At most one entry per calendar of the group.
    entries = F.array_sort(F.collect_list(F.struct("calendar", "period")))
    return materialize(covered.groupBy(*by, "tenday_no").agg(entries.alias("entries")), "calendar-periods")


def classify_calendars(df: DataFrame, rules: DataFrame, by: Sequence[str] = ("wide",)) -> DataFrame:
    """Each row once for every calendar that covers its group and ten-day, with ``calendar``
    and ``period``. Rows that no calendar covers are dropped."""
    met = df.drop("calendar", "period").join(calendar_periods(rules, by), [*by, "tenday_no"])
    return met.withColumn("entry", F.explode("entries")).select(
        *[c for c in met.columns if c != "entries"], "entry.calendar", "entry.period"
    )


def feature_table_calendars(
    daily: DataFrame,
    rules: DataFrame,
    specs: Sequence[FeatureSpec] = FEATURE_SPECS,
    keys: Sequence[str] = DEFAULT_KEYS,
    by: Sequence[str] = ("wide",),
) -> DataFrame:
    """The feature tables of all calendars on top of each other, keyed by ``calendar``.

    Days are first reduced to one state per key and ten-day, in the only shuffle of the
    weather. Then a state is repeated for each calendar that covers it: at most 36 rows per
    key multiply, not the days, so further calendars cost next to nothing.
    """
    statistics = [(s.var, s.stat) for s in specs]
    state_keys = list(dict.fromkeys([*keys, *by, "tenday_no"]))
    wanted = [*state_keys, *dict.fromkeys(s.var for s in specs)]
    # Ten-days outside all calendars are dropped before the shuffle.
    covered = calendar_periods(rules, by)
    states = (
        daily.select(*wanted)
        .join(covered.select(*by, "tenday_no"), [*by, "tenday_no"], "left_semi")
        .groupBy(*state_keys)
        .agg(*make_states(statistics))
    )
    met = states.join(covered, [*by, "tenday_no"]).withColumn("entry", F.explode("entries"))
    met = met.withColumns({"calendar": F.col("entry.calendar"), "period": F.col("entry.period")})
    out = ["calendar", *keys]
    wide = met.groupBy(*out).pivot("period", list(PERIODS)).agg(
        *[final(s.var, s.stat).alias(s.name) for s in specs]
    )
    if len(specs) == 1:
        names = {p: f"{specs[0].name}_{p}" for p in PERIODS}
    else:
        names = {f"{p}_{s.name}": f"{s.name}_{p}" for s in specs for p in PERIODS}
    return wide.withColumnsRenamed(names).select(*out, *feature_columns(specs))
