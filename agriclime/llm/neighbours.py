"""Approximate nearest neighbours by shifted space-filling curves.

Largest inner product becomes nearness by one more coordinate: candidates get
sqrt(M^2 - |x|^2) with the greatest norm M, queries get 0 and the norm M. ``CURVES``
Hilbert curves order the rows, each over ``DIMS`` random orthogonal directions with a random
shift. A curve's order is made by range partitioning and numbered without gaps; it is cut
into tiles. A query meets the tiles within its window on every curve, is compared with
their rows in double precision, and the windows' best rows are merged.

The window follows from the data: for a bounded sample of queries (``SAMPLE``) the exact
neighbours are found, and the window is the least rank distance that holds the share
``RECALL`` of them on the nearest of the curves.

Equal vectors are one row of all this, known by their least ``vec_id``; it carries the least
``k + 1`` ids, which take its place once the best vectors are known. A vector's own copies
are candidates of it wherever the curves lead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agriclime.llm.common import small
from agriclime.llm.curves import positions
from agriclime.sources.tables import materialize

CURVES, DIMS, BITS = 12, 6, 10
SAMPLE = 256
RECALL = 0.96
TILE = 4_096
_PAIRS = 1 << 14  # pairs whose products are taken at once
_ROUNDING = 1e-12  # by which products of matrices may differ from those taken pair by pair


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten()).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of usable rows: finite, not all zero, of the most frequent length.

    Of a repeated ``vec_id`` the least vector counts; rows without ``vec_id`` do not.
    """
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(v, x -> x <> 0)"
    )
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return good
    good = good.where(F.size("v") == common["d"])
    if good.groupBy("vec_id").count().where("count > 1").limit(1).count():
        good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    return good


def _order(dims: int, norm: float, seed: int):
    """Curve positions of all rows, as candidates and (``is_query``) once more as queries."""
    rng = np.random.default_rng(seed)
    turns = []
    for _ in range(CURVES):
        q, _ = np.linalg.qr(rng.normal(size=(dims + 1, min(DIMS, dims + 1))))
        turns.append((q, rng.normal(size=q.shape[1]) * 0.3))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            length = np.sqrt((x * x).sum(1))
            asked = np.asarray(batch.column("is_query"))
            rest = np.sqrt(np.maximum(norm * norm - length * length, 0))
            lifted = np.column_stack([x, rest])
            lifted[asked] = np.column_stack([x[asked] * (norm / length[asked])[:, None], np.zeros(asked.sum())])
            for curve, (turn, shift) in enumerate(turns):
                z = lifted @ turn / norm * np.sqrt(dims + 1) + shift
                cell = np.clip((1 / (1 + np.exp(-1.7 * z)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), curve, np.int32)), pa.array(positions(cell, BITS)),
                        batch.column("vec_id"), batch.column("is_query"), batch.column("v"),
                    ],
                    ["curve", "key", "vec_id", "is_query", "v"],
                )

    return run


def _best(scores: np.ndarray, k: int, q: np.ndarray, c: np.ndarray, ids: np.ndarray):
    """Row, column and score of the ``k`` greatest of each row, ties by id; -inf never.

    Of ``scores`` all that may belong to them are kept, and taken again pair by pair.
    """
    held = scores > -np.inf
    if scores.shape[1] > k:
        least = np.partition(scores, -k, 1)[:, -k]
        size = np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1).max(initial=0))
        held &= scores >= (least - _ROUNDING * size)[:, None]
    row, column = np.nonzero(held)
    score = np.empty(len(row))
    for i in range(0, len(row), _PAIRS):
        at = slice(i, i + _PAIRS)
        score[at] = (q[row[at]] * c[column[at]]).sum(1)
    order = np.lexsort((ids[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k], score[place < k]


def _exact(batches_of, k: int):
    def run(batches):
        ids, q = batches_of.value
        for batch in batches:
            own = np.asarray(batch.column("vec_id"))
            x = _matrix(batch.column("v"))
            scores = q @ x.T
            scores[ids[:, None] == own[None, :]] = -np.inf
            row, column, score = _best(scores, k, q, x, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(own[column]), pa.array(score)], ["query_id", "vec_id", "score"]
            )

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(window: int, k: int):
    def run(key, table):
        asked = table.column("is_query").to_numpy()
        q_at, c_at = np.flatnonzero(asked), np.flatnonzero(~asked)
        ids, ranks = table.column("vec_id").to_numpy(), table.column("rank").to_numpy()
        x = _matrix(table.column("v"))
        c, out = x[c_at], []
        for i in range(0, len(q_at) if len(c_at) else 0, 512):
            at = q_at[i : i + 512]
            scores = x[at] @ c.T
            scores[np.abs(ranks[at][:, None] - ranks[c_at][None, :]) > window] = -np.inf
            scores[ids[at][:, None] == ids[c_at][None, :]] = -np.inf
            row, column, score = _best(scores, k, x[at], c, ids[c_at])
            out.append((ids[at[row]], ids[c_at[column]], score))
        columns = [np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3)]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL, seed: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows found for every query row.

    ``vectors`` has (vec_id, embedding); ``is_query`` is a condition on them. Ties go to the
    smaller ``vec_id``. No usable rows: no result rows.
    """
    spark = vectors.sparkSession
    every = materialize(taking_part(vectors), "vectors")
    least = Window.partitionBy("v").orderBy("vec_id")  # tasks cut a vector's ids before the shuffle
    rows = every.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1).groupBy("v")
    rows = rows.agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    copies = materialize(rows.select("vec_id", "v", "ids"), "distinct-vectors")
    rows = copies.select("vec_id", "v")
    queries = every.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    queries = queries.join(copies.select("v", F.col("vec_id").alias("group")), "v").select("query_id", "group")
    queries = materialize(queries, "queries")
    asking = queries.select(F.col("group").alias("vec_id")).distinct()
    asking = materialize(rows.join(asking, "vec_id"), "asking")
    seen = rows.select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("n"), "v")
    seen = seen.agg(F.max("n").alias("n"), F.max(F.size("v")).alias("d"), F.count("*").alias("rows")).first()
    if not seen["rows"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm, dims = float(np.sqrt(seen["n"])), seen["d"]
    both = rows.withColumn("is_query", F.lit(False)).unionByName(asking.withColumn("is_query", F.lit(True)))
    kind = rows.schema["v"].dataType.simpleString()
    spread = both.mapInArrow(_order(dims, norm, seed), f"curve int, key long, vec_id long, is_query boolean, v {kind}")
    parts = max(CURVES, -(-seen["rows"] * CURVES // (8 * TILE)))
    spread = spread.repartitionByRange(parts, "curve", "key", "vec_id", "is_query")
    spread = spread.sortWithinPartitions("curve", "key", "vec_id", "is_query")
    spread = materialize(spread.withColumn("at", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("at", 33)
    sizes = spread.groupBy("curve", part.alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = spread.withColumn("part", part).join(small(materialize(sizes, "offsets")), ["curve", "part"])
    ranked = ranked.withColumn("rank", F.col("at") - F.col("low") + F.col("before")).drop("at", "low", "before", "part", "key")

    picked = asking.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(SAMPLE).toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast((picked["vec_id"].to_numpy(), _matrix(picked["v"])))
    pairs = rows.mapInArrow(_exact(shared, k), "query_id long, vec_id long, score double")
    truth = materialize(_top(pairs, k).select("query_id", "vec_id"), "sample")
    own = ranked.select("curve", "vec_id", "is_query", "rank")
    asked = own.where("is_query").select("curve", F.col("vec_id").alias("query_id"), F.col("rank").alias("q"))
    other = own.where("not is_query").select("curve", "vec_id", F.col("rank").alias("c"))
    apart = truth.join(asked, "query_id").join(other, ["curve", "vec_id"])
    apart = apart.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("q") - F.col("c"))).alias("apart"))
    window = int(apart.agg(F.percentile("apart", recall).alias("w")).first()["w"] or 0) + 1

    reach = -(-window // TILE)
    tile = F.expr(f"rank div {TILE}")
    asked = ranked.where("is_query").withColumn("tile", F.explode(F.sequence(tile - reach, tile + reach)))
    tiles = ranked.where("not is_query").withColumn("tile", tile).unionByName(asked)
    found = tiles.groupBy("curve", "tile").applyInArrow(_searched(window, k), "query_id long, vec_id long, score double")
    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = found.unionByName(asking.select(F.col("vec_id").alias("query_id"), "vec_id", own.alias("score")))
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # A query may be one of the ids itself, so one more is kept until then.
    best = materialize(_top(merged, k + 1).drop("rank"), "best-vectors")
    best = best.join(copies.select("vec_id", "ids"), "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score")
    best = materialize(_top(best, k + 1).select(F.col("query_id").alias("group"), "vec_id", "score"), "best")
    pairs = queries.join(best, "group").where("vec_id <> query_id")
    return _top(pairs, k).select("query_id", "rank", "vec_id", "score")
