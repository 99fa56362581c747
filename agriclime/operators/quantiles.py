"""Exact quantiles of large groups without collecting or sorting a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize

# The sketch is off by at most count / ACCURACY ranks; the first bracket around a wanted
# rank is ten times as wide on both sides.
ACCURACY = 10_000
MARGIN = 10.0 / ACCURACY
# Brackets with more different values than this are split into so many slots until none is left.
SORTED_AT_ONCE = 100_000
SLOTS = 64


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    names: dict[str, float],
    sorted_at_once: int = SORTED_AT_ONCE,
) -> DataFrame:
    """Interpolated quantiles (position (n-1)p between sorted values) per group.

    A mergeable sketch brackets each wanted rank. Rows outside all brackets are only counted,
    by the gap they lie in; those inside, about 0.2 % of a group besides equal values, which
    collapse into counts, are kept. A bracket with more than ``sorted_at_once`` different
    values is refined by counts until no task sorts more than that. ``names`` maps result
    columns to probabilities. Missing values are ignored.
    """
    groups = list(groups)
    if not groups:
        raise ValueError("quantiles are taken per group: name at least one key column")
    present = df.select(*groups, F.col(value).alias("v")).where(F.col("v").isNotNull())
    keys = [*groups, "name"]
    found = materialize(_first_brackets(present, groups, names), "quantile-values")
    while True:
        sizes = found.where("v is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("different"))
        large = sizes.where(F.col("different") > sorted_at_once)
        if not large.limit(1).count():
            break
        found = materialize(_refined(found, large, keys), "quantile-values")

    order = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.withColumn("through", F.sum("rows").over(upto))
    low = F.min(F.when(F.col("through") > F.col("low_rank"), F.col("v")))
    high = F.min(F.when(F.col("through") > F.col("low_rank") + 1, F.col("v")))
    share = F.first("share")
    result = F.when(share > 0, low + (high - low) * share).otherwise(low)
    wide = ranked.groupBy(*groups).pivot("name", list(names)).agg(result)
    return wide.select(*groups, *names)


def _same(left: Sequence[str], prefix: str):
    same = F.lit(True)
    for c in left:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def _first_brackets(present: DataFrame, groups: list[str], names: dict[str, float]) -> DataFrame:
    """(groups, name, low_rank, share, v, rows): the values inside each bracket, and one row
    with a null value that counts all below it."""
    marks = [b for p in names.values() for b in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    sketch = present.groupBy(*groups).agg(
        F.count("v").alias("rows"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", marks, ACCURACY).alias("marks"),
    )
    # The ends of a group, and small groups, need no sketch.
    few, reach = F.col("rows") < ACCURACY, F.col("rows") * MARGIN
    brackets = []
    for i, (name, p) in enumerate(names.items()):
        position = (F.col("rows") - 1) * F.lit(float(p))
        brackets.append(
            F.struct(
                F.when(few | (position <= reach), F.col("least")).otherwise(F.get("marks", F.lit(2 * i))).alias("lo"),
                F.when(few | (position + 1 >= F.col("rows") - 1 - reach), F.col("most"))
                .otherwise(F.get("marks", F.lit(2 * i + 1)))
                .alias("hi"),
                F.lit(name).alias("name"),
                F.floor(position).alias("low_rank"),
                (position - F.floor(position)).alias("share"),
            )
        )
    # One row per group, its brackets in order of their lower ends.
    bounded = materialize(
        sketch.select(*[F.col(g).alias(f"g_{g}") for g in groups], F.array_sort(F.array(*brackets)).alias("brackets")),
        "quantile-brackets",
    )
    keyed = present.join(bounded, _same(groups, "g_"))
    # Below how many brackets a row lies, and the brackets that hold it.
    under = F.size(F.filter("brackets", lambda b: F.col("v") < b["lo"]))
    none = F.lit(None)
    entry = "struct<under: int, name: string, v: double>"
    outside = F.struct(under.alias("under"), none.alias("name"), none.alias("v")).cast(entry)
    inside = F.transform(
        F.filter("brackets", lambda b: F.col("v").between(b["lo"], b["hi"])),
        lambda b: F.struct(none.alias("under"), b["name"].alias("name"), F.col("v").alias("v")).cast(entry),
    )
    counted = (
        keyed.select(*groups, F.explode(F.concat(F.array(outside), inside)).alias("e"))
        .groupBy(*groups, "e.under", "e.name", "e.v")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    counted = materialize(counted, "quantile-counts").join(bounded, _same(groups, "g_"))
    # The k-th bracket from the top has those below that lie under k brackets or more.
    n = len(names)
    per_name = counted.select(*groups, "under", "name", "v", "rows", F.posexplode("brackets").alias("at", "b"))
    per_name = per_name.where(
        F.when(F.col("under").isNotNull(), F.col("under") >= n - F.col("at")).otherwise(F.col("name") == F.col("b.name"))
    )
    return per_name.groupBy(*groups, F.col("b.name").alias("name"), "b.low_rank", "b.share", "v").agg(
        F.sum("rows").alias("rows")
    )


def _refined(found: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """The large brackets cut to the slots that hold the wanted ranks; the others as they are."""
    named = large.select(*[F.col(k).alias(f"l_{k}") for k in keys])
    marks = [(i + 1) / SLOTS for i in range(SLOTS - 1)]
    # All values of a bracket differ, so its slots have about equal numbers of them.
    cuts = (
        found.where("v is not null")
        .join(named, _same(keys, "l_"), "left_semi")
        .groupBy(*[F.col(k).alias(f"m_{k}") for k in keys])
        .agg(F.percentile_approx("v", marks, ACCURACY).alias("marks"))
    )
    cuts = materialize(cuts, "quantile-slots")
    # Slot 0 is what lies below the bracket; brackets that stay have no slots.
    met = found.join(cuts, _same(keys, "m_"), "left")
    slot = F.when(F.col("marks").isNull(), F.lit(None)).when(F.col("v").isNull(), F.lit(0)).otherwise(
        1 + F.size(F.filter("marks", lambda m: m < F.col("v")))
    )
    met = met.withColumn("slot", slot)
    rest = ["low_rank", "share"]
    totals = met.where("slot is not null").groupBy(*keys, *rest, "slot").agg(F.sum("rows").alias("rows"))
    upto = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("through", F.sum("rows").over(upto))
    ends = totals.groupBy(*[F.col(k).alias(f"e_{k}") for k in keys]).agg(
        F.min(F.when(F.col("through") > F.col("low_rank"), F.col("slot"))).alias("first"),
        F.min(F.when(F.col("through") > F.col("low_rank") + 1, F.col("slot"))).alias("last"),
    )
    ends = materialize(ends, "quantile-ends")
    kept = met.join(ends, _same(keys, "e_"), "left")
    last = F.coalesce("last", "first")
    below = (F.col("slot") < F.col("first")).alias("below")
    kept = kept.where(F.col("slot").isNull() | (F.col("slot") <= last))
    return kept.groupBy(*keys, *rest, F.when(~F.coalesce(below, F.lit(False)), F.col("v")).alias("v")).agg(
        F.sum("rows").alias("rows")
    )
