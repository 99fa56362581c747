"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agriclime.llm.common import discard, store


def _ordered(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a long, b long); component: least node.

    Every round each node joins the neighbour (or itself) with the least hash, links are
    renamed, and those inside a node vanish; the nodes left shrink by a constant factor
    expected, chains included. Stage tables cut the lineage of each round.
    """
    live = store(_ordered(links), "links")
    names, made = None, []
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("node")))
        joined = both.groupBy("a").agg(near.alias("near")).select(
            F.col("a").alias("node"),
            F.when(F.col("near.h") < F.xxhash64("a"), F.col("near.node")).otherwise(F.col("a")).alias("root"),
        )
        joined = store(joined, "roots")
        left = joined.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = joined.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = live.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        passed, live = live, store(_ordered(renamed), "links")
        discard(passed)
        made.append(joined)
        if names is None:
            names = joined
        else:
            step = joined.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            names = names.join(step, "root", "left").select(
                "node", F.coalesce("_next", "root").alias("root")
            )
    if names is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = store(names, "names")
    discard(live, *made)
    least = store(names.groupBy("root").agg(F.min("node").alias("component")), "least")
    return names.join(least, "root").select("node", "component")
