"""Missing-value rules.

The engine's only missing value is null. Not-a-number is turned into null where
data enters and again inside the aggregates below, so a single NaN never poisons
a mean. Casts never raise: text that is no number becomes null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def null_out_nan(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by null in the given (default: all floating point) columns."""
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in cols})


# Casts also take Java's suffixes ('90d', '90f') for numbers; these rules do not.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def safe_int(c: Column | str) -> Column:
    """Integer part of a numeric text ('12.7' gives 12); null for anything else."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double").try_cast("int"))


def mean_present(c: Column | str) -> Column:
    """Mean of the present values; null when there are none."""
    return F.avg(nan_to_null(c))


def sum_or_zero(c: Column | str) -> Column:
    """Sum of the present values; 0 when there are none."""
    return F.coalesce(F.sum(nan_to_null(c)), F.lit(0.0))


def max_present(c: Column | str) -> Column:
    return F.max(nan_to_null(c))


def min_present(c: Column | str) -> Column:
    return F.min(nan_to_null(c))


def growing_degree_sum(c: Column | str, base: float = 10.0) -> Column:
    """Degree sum above ``base``, clipped at 0 after (not before) the summation."""
    return F.greatest(sum_or_zero(nan_to_null(c) - F.lit(float(base))), F.lit(0.0))


def matches(c: Column | str, pattern: str) -> Column:
    """Regex test that is False, not null, for a null text (so its negation keeps the row)."""
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))
