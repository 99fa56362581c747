"""Removal of rows by their position in key order.

The keys are read on their own to find a position and stored once; pass a stage table
(``sources.tables.materialize``) when the rows are expensive to compute.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize

# Up to this many leading rows a bounded top-n is cheaper than a full sort.
TOP_N_LIMIT = 10_000


def _ascending(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in keys]


def _descending(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).desc_nulls_first() for k in keys]


def without_keys(df: DataFrame, drop: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti join in which missing keys equal each other."""
    other = drop.select([F.col(k).alias(f"drop_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"drop_{k}")) for k in keys])
    return df.join(other, same, "left_anti")


def trim_edge_groups(
    df: DataFrame, keys: Sequence[str], head: int = 5, tail: int = 1
) -> DataFrame:
    """Drop the first ``head`` and last ``tail`` rows in key order, missing keys last.

    Short edges are bounded top-n selections over the key columns alone; the broadcast
    side then holds ``head + tail`` rows. Longer ones number the keys in ranges
    (``numbered``), and the join decides from the edges' size.
    """
    only_keys = df.select(*keys)
    if max(head, tail) <= TOP_N_LIMIT:
        only_keys = materialize(only_keys, "edge-keys")
        first = only_keys.orderBy(*_ascending(keys)).limit(head)
        last = only_keys.orderBy(*_descending(keys)).limit(tail)
        return without_keys(df, F.broadcast(first.unionAll(last)), keys)
    order = numbered(only_keys, keys)
    total = order.agg(F.max("ordinal").alias("n")).first()["n"] or 0
    edge = order.where((F.col("ordinal") <= head) | (F.col("ordinal") > total - tail))
    return without_keys(df, edge.select(*keys), keys)


def _sliced(only_keys: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The keys stored by ranges, with their slice number, and the rows up to each slice."""
    ranged = only_keys.repartitionByRange(*_ascending(keys)).withColumn(
        "slice", F.spark_partition_id()
    )
    stored = materialize(ranged, "ordered-keys")
    # One row per range partition: small whatever the data holds.
    counts = stored.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stored, counts.withColumn("through", F.sum("rows").over(upto))


def numbered(only_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with ``ordinal``, their position from 1 in key order; each slice is a task's."""
    stored, counts = _sliced(only_keys, keys)
    within = Window.partitionBy("slice").orderBy(*_ascending(keys))
    before = F.col("through") - F.col("rows")
    ordered = stored.join(counts, "slice").withColumn("ordinal", before + F.row_number().over(within))
    return materialize(ordered.select(*keys, "ordinal"), "numbered-keys")


def row_at(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The key of the ``n``-th row (from 1) in key order; empty when there is none.

    ``keys`` must identify a row. Small positions use a bounded top-n. Larger ones
    sort the keys by range, store them with their partition number, count per
    partition, and number the rows of the one partition that holds the position.
    """
    only_keys = df.select(*keys)
    if n < 1:
        return only_keys.limit(0)
    if n <= TOP_N_LIMIT:
        head = only_keys.orderBy(*_ascending(keys)).limit(n)
        numbered = head.agg(F.count(F.lit(1)).alias("present"))
        last = head.orderBy(*_descending(keys)).limit(1)
        reached = numbered.select(F.col("present") == n).scalar()
        return last.where(reached)
    stored, counts = _sliced(only_keys, keys)
    target = (
        counts.where((F.col("through") >= n) & (F.col("through") - F.col("rows") < n))
        .select("slice", (F.lit(n) - F.col("through") + F.col("rows")).alias("position"))
    )
    within = Window.partitionBy("slice").orderBy(*_ascending(keys))
    return (
        stored.join(target, "slice")
        .withColumn("ordinal", F.row_number().over(within))
        .where(F.col("ordinal") == F.col("position"))
        .select(*keys)
    )


def drop_row_at(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Drop the ``n``-th row in key order; nothing happens when there is no such row."""
    return without_keys(df, F.broadcast(row_at(df, keys, n)), keys)


def _spans(positions: Iterable[int], total: int) -> list[tuple[int, int]]:
    """Ascending spans (first, last) of the positions from 1; negative ones count from the end."""
    out: list[tuple[int, int]] = []
    for n in sorted({p if p > 0 else total + 1 + p for p in positions if p}):
        if not 1 <= n <= total:
            continue
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def rows_at(df: DataFrame, keys: Sequence[str], positions: Iterable[int]) -> DataFrame:
    """``keys`` and ``ordinal`` of the rows at these positions in key order, missing keys last.

    Positions count from 1, negative ones from the end (-1 is the last row); those that do
    not exist, and 0, have no row. ``keys`` must identify a row. One range shuffle of the
    keys serves all positions: only the slices that hold one are numbered, each in a task of
    its own.
    """
    stored, counts = _sliced(df.select(*keys), keys)
    # One row per range partition, as small as the partitions are few.
    slices = sorted((r["slice"], r["rows"]) for r in counts.collect())
    total = sum(n for _, n in slices)
    spans, wanted, before = _spans(positions, total), [], 0
    for number, n in slices:
        while spans and spans[0][0] <= before + n:
            first, last = spans[0]
            wanted.append((number, before, first, min(last, before + n)))
            if last > before + n:
                spans[0] = (before + n + 1, last)
                break
            spans.pop(0)
        before += n
    spark = df.sparkSession
    asked = spark.createDataFrame(wanted, "slice int, before long, first long, last long")
    held = spark.createDataFrame(sorted({w[:2] for w in wanted}), "slice int, before long")
    within = Window.partitionBy("slice").orderBy(*_ascending(keys))
    ranked = stored.join(F.broadcast(held), "slice").withColumn(
        "ordinal", F.col("before") + F.row_number().over(within)
    )
    met = ranked.join(
        asked.select(F.col("slice").alias("at"), "first", "last"),
        (F.col("slice") == F.col("at")) & F.col("ordinal").between(F.col("first"), F.col("last")),
        "left_semi",
    )
    return met.select(*keys, "ordinal")


def drop_rows_at(df: DataFrame, keys: Sequence[str], positions: Iterable[int]) -> DataFrame:
    """Drop the rows at several positions at once (see :func:`rows_at`), both edges included."""
    return without_keys(df, materialize(rows_at(df, keys, positions), "rows-at").select(*keys), keys)
