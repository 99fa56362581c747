"""Two-pass external shuffle into shards of equal row counts, in DataFrame functions only.

Pass one scatters the rows by a seeded hash into as many buckets as keep one bucket in
memory; pass two permutes every bucket by Fisher-Yates (Spark's ``shuffle`` of an array)
and numbers the rows gaplessly. Row number ``p`` of the whole order goes to shard
``p mod n``, slot ``p div n``, so shard sizes differ by one row at most.

The scatter depends on the key and the seed alone, so a lost task is repeated with the
same rows. Rows with equal keys share a bucket; a null key is a key like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agriclime.llm.common import quoted, without
from agriclime.sources.tables import partitioned_writer

BUCKET_BYTES = 4 << 20
_GROUP = 1_000


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket: sums of whole bucket groups, then sums inside a group."""
    grouped = counts.withColumn("_group", F.expr(f"bucket div {_GROUP}"))
    inside = Window.partitionBy("_group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_group").agg(F.sum("n").alias("_n"))
    groups = groups.select("_group", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    return (
        grouped.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(groups, "_group")
        .select("bucket", (F.col("_inside") + F.col("_before")).alias("_offset"))
    )


def external_shuffle(
    df: DataFrame,
    key: Sequence[str],
    size: Column,
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``df`` with ``position``: its place, from 0 without gaps, in a seeded random order.

    ``size`` gives a row's bytes; the bucket count follows from their sum. An empty table
    stays empty; a column named ``position`` is replaced.
    """
    df = without(df, ["position"])
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[quoted(k) for k in key]), F.lit(buckets))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    row = F.struct(*[quoted(c) for c in df.columns])
    # Order before the permutation: by a second seeded hash, so that a repeated task agrees.
    tied = F.struct(F.xxhash64(F.lit(seed + 1), *[quoted(k) for k in key]).alias("tie"), row.alias("row"))
    # A task gets about four buckets, however large the table is.
    permuted = (
        df.select(bucket.alias("bucket"), tied.alias("tied"))
        .repartition(max(1, -(-buckets // 4)), "bucket")
        .groupBy("bucket")
        .agg(F.collect_list("tied").alias("rows"))
        .select("bucket", F.array_sort("rows", _by_tie).alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("rows", seed).alias("rows"))
    )
    return (
        permuted.join(_offsets(counts), "bucket")
        .select("_offset", F.posexplode("rows").alias("_at", "_row"))
        .select("_row.row.*", (F.col("_offset") + F.col("_at")).alias("position"))
    )


def _by_tie(a: Column, b: Column) -> Column:
    return F.when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)


def shards(df: DataFrame, count: int, key: Sequence[str], size: Column, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0 to ``count`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    placed = external_shuffle(without(df, ["shard", "slot"]), key, size, seed)
    return placed.withColumns(
        {
            "shard": F.pmod(F.col("position"), F.lit(count)).cast("int"),
            "slot": F.expr(f"position div {int(count)}").cast("long"),
        }
    ).drop("position")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; a large shard is several files, each in slot order."""
    ordered = partitioned_writer(df.sortWithinPartitions("shard", "slot"), ["shard"], rebalance=False)
    ordered.parquet(path)
