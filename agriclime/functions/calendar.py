"""Calendar parts of textual ISO dates and the ten-day numbering of a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENDAYS_PER_YEAR = 36


def _part(date_col: str, start: int, length: int) -> Column:
    return F.substring(F.col(date_col), start, length).try_cast("int")


# Comparisons are added up rather than chained in a CASE: a missing day stays missing
# without a test, and the text is parsed less often per row.
def half_of(day: Column) -> Column:
    """1 for the second half of a month (day 15 on), 2 for the first: the coding the data uses."""
    return F.lit(2) - (day >= 15).cast("int")


def ten_day_of(day: Column) -> Column:
    """1 for days 1-10, 2 for 11-20, 3 from 21 on; null for a missing day."""
    return F.lit(1) + (day > 10).cast("int") + (day >= 21).cast("int")


def _text_bounds(date_col: str, first: int, last: int | None) -> list[Column]:
    """Comparisons of the date text that follow from its first four characters' range.

    A number of four digits fills all four characters, so text and number sort alike.
    """
    if not 1000 <= first <= (last or first) < 9999:
        return []
    bounds = [F.col(date_col) >= F.lit(str(first))]
    if last is not None:
        bounds.append(F.col(date_col) < F.lit(str(last + 1)))
    return bounds


def calendar_parts(
    df: DataFrame, date_col: str = "date", years: tuple[int, int | None] | None = None
) -> DataFrame:
    """Add year, month, day, half and ten_day.

    Each part is read on its own, so '2001-01' still has a year and a month. ``years``
    (first and last, or no last) keeps the rows of these years only; as the year is made
    here, from the date's first characters, that filter also reaches the file scan.
    """
    if years is not None:
        first, last = years
        for bound in _text_bounds(date_col, first, last):
            df = df.where(bound)
        kept = since_year if last is None else in_years
        return kept(calendar_parts(df, date_col), *[y for y in years if y is not None])
    day = _part(date_col, 9, 2)
    return df.withColumns(
        {
            "year": _part(date_col, 1, 4),
            "month": _part(date_col, 6, 2),
            "day": day,
            "half": half_of(day),
            "ten_day": ten_day_of(day),
        }
    )


def tenday_number(month: Column | int, ten_day: Column | int) -> Column | int:
    """Ten-day of the year, 1..36; also works on plain integers."""
    return (month - 1) * 3 + ten_day


def tenday_key(df: DataFrame) -> DataFrame:
    """Add the text key mon_third ('month_tenday') and the number tenday_no."""
    month, ten_day = F.col("month"), F.col("ten_day")
    return df.withColumns(
        {
            "mon_third": F.concat(month.cast("string"), F.lit("_"), ten_day.cast("string")),
            "tenday_no": tenday_number(month, ten_day),
        }
    )


def since_year(df: DataFrame, first: int) -> DataFrame:
    """Rows of year ``first`` and later."""
    return df.where(F.col("year") >= first)


def in_years(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the years ``first`` to ``last``."""
    return df.where(F.col("year").between(first, last))
