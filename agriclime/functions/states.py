"""Mergeable partial states of the climate statistics.

A state is what a group needs to remember so that groups can be united later: sum and count
for a mean, the extremes for extremes. States are plain columns, so they are made and merged
by ordinary hash aggregates, which combine on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import nan_to_null

_PARTS = {
    "mean": ("sum", "count"),
    "sum": ("sum",),
    "max": ("max",),
    "min": ("min",),
    "gdd10c": ("sum", "count"),
}
_MAKE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_MERGE = _MAKE | {"count": F.sum}


def _needed(statistics: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(variable, part) pairs, each once."""
    return list(dict.fromkeys((var, part) for var, stat in statistics for part in _PARTS[stat]))


def state_names(statistics: Iterable[tuple[str, str]]) -> list[str]:
    return [f"{var}__{part}" for var, part in _needed(statistics)]


def make_states(statistics: Iterable[tuple[str, str]]) -> list[Column]:
    """Aggregates over rows, for (variable, statistic) pairs; missing values take no part."""
    return [_MAKE[part](nan_to_null(var)).alias(f"{var}__{part}") for var, part in _needed(statistics)]


def merge_states(statistics: Iterable[tuple[str, str]]) -> list[Column]:
    """Aggregates over states that give the state of all their rows."""
    return [_MERGE[part](f"{var}__{part}").alias(f"{var}__{part}") for var, part in _needed(statistics)]


def final(var: str, stat: str, base: float = 10.0) -> Column:
    """The statistic of all rows behind the states, as an aggregate over them."""
    total, count = F.sum(f"{var}__sum"), F.sum(f"{var}__count")
    if stat == "mean":
        return total / F.nullif(count, F.lit(0))
    if stat == "sum":
        return F.coalesce(total, F.lit(0.0))
    if stat == "gdd10c":
        return F.greatest(F.coalesce(total - F.lit(base) * count, F.lit(0.0)), F.lit(0.0))
    return _MERGE[stat](f"{var}__{stat}")
