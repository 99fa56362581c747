"""Growth periods relative to the transplant ten-day, and statistics per period."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import TENDAYS_PER_YEAR, tenday_number
from ..functions.missing import (
    growing_degree_sum,
    max_present,
    mean_present,
    min_present,
    sum_or_zero,
)
from ..sources.tables import materialize
from .clean import SUBTOTAL_PATTERN, exclude_matching

PERIODS = ("P1", "P2", "P3", "P4", "P5")
DEFAULT_KEYS = ("wide", "region", "year")


@dataclass(frozen=True)
class PeriodRule:
    """Ten-day offsets ``lo``..``hi`` after transplanting; no ``hi`` means open-ended."""

    period: str
    lo: int
    hi: int | None


# Offsets per transplant month.
PERIOD_RULES = {
    5: (
        PeriodRule("P1", 0, 0),
        PeriodRule("P2", 1, 5),
        PeriodRule("P3", 6, 6),
        PeriodRule("P4", 7, 8),
        PeriodRule("P5", 9, 10),
    ),
    6: (
        PeriodRule("P1", 0, 0),
        PeriodRule("P2", 1, 5),
        PeriodRule("P3", 6, 6),
        PeriodRule("P4", 7, 8),
        PeriodRule("P5", 9, 10),
    ),
    7: (
        PeriodRule("P1", 0, 2),
        PeriodRule("P2", 3, 4),
        PeriodRule("P3", 5, 7),
        PeriodRule("P4", 8, 10),
    ),
}
# The month-5 rule as literally written; P3 never ends, so P4 and P5 stay empty.
MONTH5_LITERAL = (
    PeriodRule("P1", 0, 0),
    PeriodRule("P2", 1, 5),
    PeriodRule("P3", 6, None),
    PeriodRule("P4", 7, 8),
    PeriodRule("P5", 9, 10),
)


def period_of(offset: Column, rules: Sequence[PeriodRule]) -> Column:
    """First matching period; null outside all of them.

    The rules become a lookup list over the offsets of a year, so that the offset,
    which is derived from text, is evaluated once instead of once per rule.
    """
    first = min(rule.lo for rule in rules)
    last = max(TENDAYS_PER_YEAR if rule.hi is None else rule.hi for rule in rules)

    def matching(k: int) -> str | None:
        inside = (r.period for r in rules if r.lo <= k and (r.hi is None or k <= r.hi))
        return next(inside, None)

    periods = F.array(*[F.lit(matching(k)) for k in range(first, last + 1)])
    return F.get(periods, offset - first)


def classify_period(
    df: DataFrame,
    month: int,
    ten_day: int,
    rules: Sequence[PeriodRule] | None = None,
    literal_month5: bool = False,
) -> DataFrame:
    """Add ``period`` by the distance from the transplant ten-day; drop unclassified rows.

    Without ``rules`` those of the transplant month are used.
    """
    if rules is None:
        if month not in PERIOD_RULES:
            raise ValueError(f"no period rules for transplant month {month}: pass rules")
        rules = MONTH5_LITERAL if literal_month5 and month == 5 else PERIOD_RULES[month]
    offset = F.col("tenday_no") - F.lit(tenday_number(month, ten_day))
    return df.withColumn("period", period_of(offset, rules)).where(F.col("period").isNotNull())


def classify_period_by_group(
    df: DataFrame, rules: DataFrame, by: Sequence[str] = ("wide",)
) -> DataFrame:
    """Like :func:`classify_period`, with the rules as rows that vary by group.

    ``rules``: the ``by`` columns, month, ten_day (of transplanting), period, lo, hi
    (null: open-ended). Rules are expanded to the few ten-days they cover (at most 36
    rows per group, stored as a stage table), so the match is an equality join rather
    than a range join. Overlaps go to the lowest ``lo``, then the period name.
    """
    start = tenday_number(F.col("month"), F.col("ten_day"))
    first = F.greatest(start + F.col("lo"), F.lit(1))
    last = F.least(start + F.coalesce(F.col("hi"), F.lit(TENDAYS_PER_YEAR)),
                   F.lit(TENDAYS_PER_YEAR))
    covered = (
        rules.withColumns({"first_no": first, "last_no": last})
        .where(F.col("first_no") <= F.col("last_no"))
        .withColumn("tenday_no", F.explode(F.sequence("first_no", "last_no")))
        .groupBy(*by, "tenday_no")
        .agg(F.min_by("period", F.struct("lo", "period")).alias("period"))
    )
    return df.join(materialize(covered, "period-rules"), [*by, "tenday_no"])


STATISTICS: dict[str, Callable[[str], Column]] = {
    "mean": mean_present,
    "sum": sum_or_zero,
    "max": max_present,
    "min": min_present,
    "gdd10c": growing_degree_sum,
}


@dataclass(frozen=True)
class FeatureSpec:
    """A weather variable and the statistic taken of it per period."""

    var: str
    stat: str

    @property
    def name(self) -> str:
        return "gdd10c" if self.stat == "gdd10c" else self.var

    def column(self) -> Column:
        if self.stat not in STATISTICS:
            raise ValueError(f"unknown statistic {self.stat!r}")
        return STATISTICS[self.stat](self.var).alias(self.name)


# The eight variable / statistic pairs of the feature table.
FEATURE_SPECS = (
    FeatureSpec("tm_avg", "mean"),
    FeatureSpec("tm_min", "mean"),
    FeatureSpec("tm_max", "mean"),
    FeatureSpec("hm_avg", "mean"),
    FeatureSpec("pr_day", "sum"),
    FeatureSpec("ss_dura_sum", "mean"),
    FeatureSpec("ws_avg", "max"),
    FeatureSpec("tm_avg", "gdd10c"),
)


def feature_columns(specs: Sequence[FeatureSpec] = FEATURE_SPECS) -> list[str]:
    return [f"{s.name}_{p}" for s in specs for p in PERIODS]


def feature_table(
    classified: DataFrame,
    specs: Sequence[FeatureSpec] = FEATURE_SPECS,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """One row per key, one column ``<name>_P<n>`` per spec and period.

    All statistics come out of one aggregation (one scan, one shuffle of partial
    results) and one pivot with a fixed value list. A period without rows is null
    in every column; a period whose values are all missing has sum and degree sum 0.
    """
    # With several aggregates a pivoted column is named <period>_<alias>, with one
    # aggregate just <period>.
    wide = classified.groupBy(*keys).pivot("period", list(PERIODS)).agg(
        *[s.column() for s in specs]
    )
    if len(specs) == 1:
        names = {p: f"{specs[0].name}_{p}" for p in PERIODS}
    else:
        names = {f"{p}_{s.name}": f"{s.name}_{p}" for s in specs for p in PERIODS}
    return wide.withColumnsRenamed(names).select(*keys, *feature_columns(specs))


def period_stat(
    classified: DataFrame, var: str, stat: str, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """One statistic of one variable per period."""
    return feature_table(classified, [FeatureSpec(var, stat)], keys)


def feature_yield(
    features: DataFrame,
    yields: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    exclude_year: int | None = 2021,
    exclude_region: str = SUBTOTAL_PATTERN,
) -> DataFrame:
    """Features with the yield of the same key.

    With keys (wide, year) a feature row meets every region of the province. Rows of
    ``exclude_year`` or without a year are dropped, and regions that match the
    pattern; a missing region is kept.
    """
    wanted = yields.select("wide", "region", "year", "prod_10a_kg")
    joined = features.join(wanted, list(keys), "left")
    named = [c for c in features.columns if c not in keys]
    out = joined.select("wide", "region", "year", "prod_10a_kg", *named)
    out = exclude_matching(out, "region", exclude_region)
    if exclude_year is not None:
        out = out.where(F.col("year") != exclude_year)
    return out
