"""Links from candidate buckets without listing all pairs of a bucket.

Members of a bucket may be linked. A bucket of two is one pair. In larger ones every
member is first compared with one pivot, the member that shares most places with others;
members that a chain of links then holds together need no comparison. Later rounds take
other pivots in the buckets that still hold several components. What is then left, pairs of
different components in a bucket that were never compared, is compared in full, but for
those that cannot be linked by their attributes, by the triangle inequality over the first
pivot (where ``apart`` is a metric), or by marks made for the members still left. Where such
pairs grow with the square of a bucket, ``rest`` gets the members instead of a table of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agriclime.llm.common import discard, small, store
from agriclime.llm.components import components


def linked(
    members: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    possible: str = "true",
    limit: float = float("inf"),
    marks: Callable[[DataFrame], DataFrame] | None = None,
    close: str = "true",
    rounds: int = 1,
    rest: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """(node, component) of all nodes with a confirmed link; None if there is no link.

    ``members`` has the rows (bucket long, node long, info); ``possible`` is an SQL condition
    between ``x.info`` and ``y.info`` that every link fulfils. ``confirm`` gets (a, b) pairs,
    a < b, each once, and returns (a, b, alike, apart) of all that may be links; ``apart`` is
    null or a distance, ``limit`` at most for links. ``marks`` gives (node, mark) of the nodes
    it gets, ``close`` is an SQL condition between ``x.info``, ``x.mark``, ``y.info`` and
    ``y.mark`` that every link fulfils. ``rest`` takes the place of the last comparison: it
    gets (pivot, node, component) of all members of the buckets that still hold several
    components, by their buckets' first pivot, and returns the links (a, b) of those of one
    pivot, but for the pivot's own, which were compared. No link between two members of a
    bucket is lost as far as components go.
    """
    shared = members.groupBy("bucket").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")
    )
    shared = store(shared.where("low < high"), "shared")
    large = store(shared.where("n > 2").select("bucket", "n"), "large")
    inside = store(members.join(small(large), "bucket"), "members")
    degree = store(inside.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    central = inside.join(degree, "node").groupBy("bucket")
    central = central.agg(F.max_by("node", F.struct("degree", "node")).alias("pivot"))
    first = store(central, "pivots")
    discard(large, degree)
    pairs = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    pairs = pairs.unionByName(_pairs(inside.join(first, "bucket").where("node <> pivot"), "pivot", "node"))
    tested, links, names, apart = [], None, None, None
    kept, passing = [inside, first], [shared]  # tables for all rounds, and for this one
    for turn in range(rounds + 1):
        if turn:
            named = inside.select("bucket", "node", "info")
            if names is not None:
                named = named.join(names, "node", "left")
                named = named.withColumn("component", F.coalesce("component", "node"))
            else:
                named = named.withColumn("component", F.col("node"))
            named = store(named, "members-named")
            mixed = named.groupBy("bucket").agg(
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.max_by(F.struct("node", "component", "info"), F.xxhash64("component", "bucket")).alias("p"),
            )
            mixed = store(mixed.where("low < high").select("bucket", "p.*"), "pivots")
            passing = [named, mixed]
            if not mixed.limit(1).count():
                break
            if turn == rounds and rest is not None:
                groups = named.join(mixed.select("bucket"), "bucket", "left_semi").join(first, "bucket")
                groups = store(groups.select("pivot", "node", "component").distinct(), "groups")
                alike = rest(groups)
                kept.extend([groups, alike])
                if alike.limit(1).count():
                    links = alike if links is None else links.unionByName(alike)
                    kept.extend([names] if names is not None else [])
                    names = store(components(links), "components")
                break
            near = named.join(first, "bucket")
            if apart is not None:
                near = near.join(apart, ["pivot", "node"], "left")
            else:
                near = near.withColumn("apart", F.lit(None).cast("double"))
            fits = f"({possible}) and coalesce(abs(x.apart - y.apart) <= {limit}, true)"
            if limit == float("inf"):
                fits = f"({possible})"
            if turn == rounds and marks is not None:
                near = near.join(mixed.select("bucket"), "bucket", "left_semi")
                near = near.join(marks(near.select("node").distinct()), "node")
                fits += f" and ({close})"
            y = near.alias("y")
            if turn < rounds:
                x = near.join(mixed.select("bucket", "node"), ["bucket", "node"])
                apart_rule = "x.node <> y.node and x.component <> y.component"
            else:
                x = near.join(mixed.select("bucket"), "bucket", "left_semi")
                apart_rule = "x.node < y.node and x.component <> y.component"
            x = store(x, "askers")
            passing.append(x)
            x = x.alias("x")
            pairs = x.join(y, F.expr(f"x.bucket = y.bucket and {apart_rule} and {fits}"))
            pairs = _pairs(pairs, "x.node", "y.node")
        pairs = pairs.distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        discard(*passing)
        kept.append(pairs)
        if pairs.limit(1).count():
            told = confirm(pairs)
            found = store(told, "found")
            discard(told)
            kept.append(found)
            if not turn:
                known = found.where("apart is not null")
                flipped = known.select(F.col("b").alias("pivot"), F.col("a").alias("node"), "apart")
                known = known.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "apart")
                apart = store(known.unionByName(flipped).join(first.select("pivot").distinct(), "pivot"), "apart")
                kept.append(apart)
            alike = found.where("alike").select("a", "b")
            links = alike if links is None else links.unionByName(alike)
            old, names = names, store(components(links), "components")
            kept.extend([old] if old is not None else [])
        tested.append(pairs)
    discard(*passing, *kept)
    return names


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
