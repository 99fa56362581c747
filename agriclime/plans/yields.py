"""Yield files to detrended yields per region and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.yields import normalized_yields
from ..sources.files import read_yields


def yields_from_files(
    spark: SparkSession, paths: Sequence[str], trend: tuple[float, float] | None = None
) -> DataFrame:
    """Read, unite, detrend (on all rows), drop metropolitan areas, abbreviate provinces."""
    return normalized_yields([read_yields(spark, path) for path in paths], trend)
