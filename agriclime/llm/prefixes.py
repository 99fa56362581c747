"""Prefix trie of rebuilt conversations, from composable fingerprints of turn sequences.

A sequence of turns is a monoid element (n, s): its length and the sum of x[i] * B**i over
its turns' digests x, modulo a prime, in four independent lanes. Two sequences compose to
(n1 + n2, s1 + B**n1 * s2), and a range of a sequence is a difference of two prefixes times
a power of B. So the fingerprint of every prefix of a rebuilt conversation (the head of its
base, then its own turns after the cut) is arithmetic on prefixes of the original
conversations; rebuilt texts are never made.

Nodes are groups of equal (depth, fingerprint). Their equality is then proved by induction:
all members' prefixes one turn shorter are one group, and the last turns, kept as references
(conversation, position) to the stored turns, are one reference or hold equal role and text.
Where that fails, everything is done again with other bases.

Sums over subtrees need no walk down the trie. A node belongs to its smallest member, and the
nodes that one conversation owns are the last part of its own path. A subtree's sums are
therefore sums over the node's members of what each one owns below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.llm.common import small
from agriclime.sources.tables import materialize

PRIME = (1 << 31) - 1
LANES = 4
# A conversation's turns meet its head's data in blocks of so many, so that a conversation
# with most of all turns is no hot key.
BLOCK_TURNS = 4096
# Members' ids are hashed in chunks of at most so many.
CHUNK_IDS = 50_000

_S = [f"s{i}" for i in range(LANES)]
_T = [f"t{i}" for i in range(LANES)]
_KEY = ["depth", "k0", "k1"]


def bases(seed: int) -> list[int]:
    """One base for each lane."""
    digest = hashlib.sha256(f"turn bases {seed}".encode()).digest()
    return [2 + int.from_bytes(digest[8 * i : 8 * i + 8], "big") % (PRIME - 3) for i in range(LANES)]


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo the prime, all at once."""
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def _prefixes(turns: DataFrame, base: list[int]) -> DataFrame:
    """The sorted turns with their place in this task's part of the conversation, their terms
    and the sums up to and with them."""
    schema = T.StructType(
        [f for f in turns.schema.fields if f.name not in ("turn", "digest")]
        + [T.StructField(n, T.LongType()) for n in ("part", "place", "sum_bytes")]
        + [T.StructField(n, T.IntegerType()) for n in _T + _S]
    )
    names = [f.name for f in schema.fields]

    def run(batches):
        from pyspark import TaskContext

        part, last, seen, carried, sum_bytes = TaskContext.get().partitionId(), None, 0, np.zeros(LANES, np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = np.asarray(batch.column("conv_id"))
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            goes_on = last is not None and conv[0] == last
            head = run_of == 0 if goes_on else np.zeros(n, bool)
            place = np.arange(n) - starts[run_of] + np.where(head, seen, 0)
            raw = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(n, -1)
            made, ends = {}, np.r_[starts[1:], n] - 1

            def since_start(values, before):
                total = np.cumsum(values)
                return total - (total - values)[starts][run_of] + np.where(head, before, 0)

            for i in range(LANES):
                term = (raw[:, i] % np.uint64(PRIME)).astype(np.int64) * _powers(base[i], place) % PRIME
                made[_T[i]] = term.astype(np.int32)
                made[_S[i]] = (since_start(term, carried[i]) % PRIME).astype(np.int32)
            made["sum_bytes"] = since_start(np.asarray(batch.column("n_bytes"), np.int64), sum_bytes)
            made["place"], made["part"] = place, np.full(n, part)
            last, seen, sum_bytes = conv[-1], int(place[ends[-1]]) + 1, int(made["sum_bytes"][-1])
            carried = np.array([made[s][-1] for s in _S], np.int64)
            columns = {c: batch.column(c) for c in batch.schema.names} | made
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names)

    return turns.mapInArrow(run, schema)


def _with_power(df: DataFrame, base: list[int], exponent: str) -> DataFrame:
    """``df`` with ``p0``... : each lane's base to the power of a column."""
    names = [f"p{i}" for i in range(LANES)]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        for batch in batches:
            e = np.asarray(batch.column(exponent), np.int64)
            added = [pa.array(_powers(b, e)) for b in base]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def stored_turns(conversations: DataFrame, base: list[int]) -> DataFrame:
    """The turns in order, written once: position in the conversation, bytes, prefix sums.

    Sorting deals out ranges, so a long conversation lies in several parts; what came before
    each part is composed from one element per part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = _prefixes(turns.repartitionByRange(*order).sortWithinPartitions(*order), base)
    placed = materialize(placed, "turns")

    parts = placed.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"),
        F.max_by(F.struct(*_S, "sum_bytes"), "place").alias("all"),
    )
    by = Window.partitionBy("conv_id")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns(
        {"n_parts": F.count("*").over(by), "first": F.coalesce(F.sum("n").over(before), F.lit(0))}
    ).where("n_parts > 1")
    parts = _with_power(parts, base, "first")
    earlier = {"first_bytes": F.coalesce(F.sum("all.sum_bytes").over(before), F.lit(0))} | {
        f"b{i}": F.coalesce(F.sum((F.col(f"p{i}") * F.col(f"all.s{i}")) % PRIME).over(before) % PRIME, F.lit(0))
        for i in range(LANES)
    }
    powers = [f"p{i}" for i in range(LANES)]
    parts = materialize(parts.withColumns(earlier).select("conv_id", "part", "first", *powers, *earlier), "turn-parts")

    joined = placed.join(small(parts), ["conv_id", "part"], "left")
    lane = {}
    for i in range(LANES):
        power = F.coalesce(F.col(f"p{i}"), F.lit(1))
        lane[f"t{i}"] = (power * F.col(f"t{i}")) % PRIME
        lane[f"s{i}"] = (F.coalesce(F.col(f"b{i}"), F.lit(0)) + power * F.col(f"s{i}")) % PRIME
    return joined.select(
        "conv_id",
        (F.col("place") + F.coalesce("first", F.lit(0))).alias("position"),
        "role",
        "text",
        "n_bytes",
        (F.col("sum_bytes") + F.coalesce("first_bytes", F.lit(0))).alias("sum_bytes"),
        *[c.alias(n) for n, c in lane.items()],
    )


def cut(conv_id: Column, siblings: int, most: int) -> Column:
    """Turns taken from the base: none if the conversation is its own base."""
    own = F.crc32(conv_id.cast("string").cast("binary")) % (most + 1)
    return F.when(conv_id % siblings == 0, F.lit(0)).otherwise(own).cast("long")


def _plans(turns: DataFrame, siblings: int, most: int) -> DataFrame:
    """One row per conversation: cut, head length, and the elements at both."""
    conv, h = F.col("conv_id"), cut(F.col("conv_id"), siblings, most)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    own_cut = turns.where(F.col("position") == h - 1).select(
        "conv_id", *[F.col(s).alias(f"own_{s}") for s in _S], F.col("sum_bytes").alias("own_bytes")
    )
    heads = turns.where((conv % siblings == 0) & (F.col("position") < most))
    sized = sizes.withColumns({"base": conv - conv % siblings, "h": h})
    of_base = sizes.where(conv % siblings == 0).select(conv.alias("base"), F.col("n_own").alias("n_base"))
    sized = sized.join(of_base, "base", "left").withColumn(
        "m", F.least("h", F.coalesce("n_base", F.lit(0)))
    )
    base_cut = heads.select(
        conv.alias("base"),
        (F.col("position") + 1).alias("m"),
        *[F.col(s).alias(f"base_{s}") for s in _S],
        F.col("sum_bytes").alias("base_bytes"),
    )
    joined = sized.join(base_cut, ["base", "m"], "left").join(own_cut, "conv_id", "left")
    sums = [f"{side}_{c}" for side in ("own", "base") for c in [*_S, "bytes"]]
    return joined.select(
        "conv_id", "base", "h", "m", "n_own",
        (F.col("m") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("n_turns"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in sums],
    )


def _pack(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[i].cast("long"), 31).bitwiseOR(lanes[i + 1].cast("long")) for i in (0, 2)]


def _named(values: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in values.items()]


def _rows(turns: DataFrame, plans: DataFrame, base: list[int], siblings: int, most: int) -> DataFrame:
    """A row for every turn of every rebuilt conversation: fingerprints with and without it."""
    heads = turns.where((F.col("conv_id") % siblings == 0) & (F.col("position") < most)).select(
        F.col("conv_id").alias("ref_conv"), "position", "n_bytes", "sum_bytes", *_S, *_T
    )
    from_base = plans.join(heads, (F.col("base") == F.col("ref_conv")) & (F.col("position") < F.col("m")))

    def row(depth, with_it, without, n_bytes, before):
        k, q = _pack(with_it), _pack(without)
        return _named(
            {
                "depth": depth.cast("long"), "k0": k[0], "k1": k[1], "q0": q[0], "q1": q[1],
                "ref_at": F.col("position"), "n_bytes": n_bytes, "before": before,
                "is_end": (depth == F.col("n_turns")).cast("int"),
            }
        )

    without = [(F.col(s) - F.col(t) + PRIME) % PRIME for s, t in zip(_S, _T)]
    head_rows = from_base.select(
        "conv_id", "ref_conv",
        *row(F.col("position") + 1, [F.col(s) for s in _S], without, F.col("n_bytes"), F.col("sum_bytes") - F.col("n_bytes")),
    )

    blocks = plans.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("n_own") / BLOCK_TURNS).cast("int"))))
    own = turns.where(F.col("position") >= cut(F.col("conv_id"), siblings, most)).withColumn(
        "block", (F.col("position") / BLOCK_TURNS).cast("int")
    )
    joined = own.join(blocks, ["conv_id", "block"])

    def moved(lane: int, value: Column) -> Column:
        inverse = pow(base[lane], -1, PRIME)
        back = F.array(*[F.lit(pow(inverse, e, PRIME)) for e in range(most + 1)])
        shift = F.element_at(back, (F.col("h") - F.col("m") + 1).cast("int"))
        rest = (value - F.col(f"own_s{lane}") + PRIME) % PRIME
        return (F.col(f"base_s{lane}") + rest * shift) % PRIME

    own_rows = joined.select(
        "conv_id", F.col("conv_id").alias("ref_conv"),
        *row(
            F.col("m") + F.col("position") - F.col("h") + 1,
            [moved(i, F.col(s)) for i, s in enumerate(_S)],
            [moved(i, w) for i, w in enumerate(without)],
            F.col("n_bytes"),
            F.col("base_bytes") + F.col("sum_bytes") - F.col("n_bytes") - F.col("own_bytes"),
        ),
    )
    return head_rows.unionByName(own_rows)


def _groups(rows: DataFrame) -> DataFrame:
    """Nodes below the root: members, ends, and what proves them equal."""
    ends = [F.min(F.when(F.col("is_end") == 1, F.col("conv_id"))).alias("end_conv"), F.sum("is_end").alias("n_ends")]
    same = F.lit(True)
    for c in ("q0", "q1"):
        same = same & (F.min(c) == F.max(c))
    one = (F.min("ref_conv") == F.max("ref_conv")) & (F.min("ref_at") == F.max("ref_at"))
    return rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("q0").alias("q0"),
        F.min("q1").alias("q1"),
        *ends,
        same.alias("one_parent"),
        one.alias("one_reference"),
    )


def collided(nodes: DataFrame, shared: DataFrame, turns: DataFrame) -> bool:
    """Whether some node's members differ: another parent, or another last turn."""
    if nodes.where("not one_parent").limit(1).count():
        return True
    asked = shared.where("not one_reference").select(*_KEY, "ref_conv", "ref_at").distinct()
    texts = turns.select(F.col("conv_id").alias("ref_conv"), F.col("position").alias("ref_at"), "role", "text")
    differ = (
        asked.join(texts, ["ref_conv", "ref_at"])
        .groupBy(*_KEY)
        .agg((F.min("role") == F.max("role")).alias("role"), (F.min("text") == F.max("text")).alias("text"))
        .where("not role or not text")
    )
    return bool(differ.limit(1).count())


def _ends_hash(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, joined ids of each key, streamed: no group is held in memory."""
    key = [T.StructField(c, T.LongType()) for c in _KEY]
    chunk = T.StructType([*key, T.StructField("first", T.LongType()), T.StructField("ids", T.StringType())])
    order = [*_KEY, "conv_id"]

    def chunks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([np.asarray(batch.column(c)) for c in _KEY])
            conv = batch.column("conv_id").to_pylist()
            change = np.flatnonzero((table[:, 1:] != table[:, :-1]).any(0)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(conv)]):
                for i in range(a, b, CHUNK_IDS):
                    part = conv[i : min(b, i + CHUNK_IDS)]
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(_KEY, table[:, a].tolist())) | {"first": part[0], "ids": ",".join(map(str, part))}],
                        pa.schema([(f, pa.int64()) for f in [*_KEY, "first"]] + [("ids", pa.string())]),
                    )

    digest = T.StructType([*key, T.StructField("ends_hash", T.StringType())])

    def hashes(batches):
        now, state, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                at = tuple(row[c] for c in _KEY)
                if at != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = at, hashlib.sha256(row["ids"].encode())
                else:
                    state.update(f",{row['ids']}".encode())
            yield from _batch(done)
            done = []
        if now is not None:
            yield from _batch([(*now, state.hexdigest())])

    def _batch(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*_KEY, "ends_hash"])

    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, chunk)
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashes, digest)


def prefix_trie(conversations: DataFrame, siblings: int = 5, most: int = 8, seeds: Iterable[int] | None = None) -> DataFrame:
    """All distinct prefixes of the rebuilt conversations, with sums over their subtrees.

    Conversation c is rebuilt from the first h turns of c - c % ``siblings`` (h is
    crc32(decimal c) % (``most`` + 1)) and its own turns after its first h; a conversation
    that is its own base stays. Result: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.

    A null role or text counts as empty. Turns are ordered by ``turn`` (null first); ties by
    role, then by the SHA-256 of role and text. Repeated rows are turns of their own. Rows
    without ``conv_id`` belong to no conversation. The remainder of a negative id is
    negative or zero. An empty table has no node, not even a root. Other columns are not read.
    """
    for seed in seeds or count():
        base = bases(seed)
        turns = stored_turns(conversations, base)
        plans = materialize(_plans(turns, siblings, most), "rebuilt")
        rows = materialize(_rows(turns, plans, base, siblings, most), "prefix-rows")
        nodes = materialize(_groups(rows), "prefix-nodes")
        several = nodes.where("n_convs > 1").select(
            *_KEY, F.col("conv_id").alias("owner"), "n_ends", "one_reference"
        )
        shared = materialize(rows.drop("q0", "q1").join(several, _KEY), "prefix-shared")
        if not collided(nodes, shared, turns):
            break
    return _trie(plans, nodes, shared)


def _trie(plans: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    zero = [F.lit(0).cast("long").alias(c) for c in _KEY]
    root = plans.agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min(F.when(F.col("n_turns") == 0, F.col("conv_id"))).alias("end_conv"),
        F.sum((F.col("n_turns") == 0).cast("int")).alias("n_ends"),
    ).where("n_convs > 0")
    kept = ["conv_id", "n_convs", "end_conv", "n_ends"]
    all_nodes = root.select(*zero, *kept).unionByName(nodes.select(*_KEY, *kept))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("q0").alias("k0"), F.col("q1").alias("k1")]
    children = nodes.select(*parent).groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    all_nodes = materialize(
        all_nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes"
    )

    # What a member owns: all of its path but the turns that it shares with a smaller member.
    not_owned = shared.where("owner <> conv_id").groupBy("conv_id").agg(F.sum("n_bytes").alias("free"))
    leaves = all_nodes.where("n_children = 0").select("conv_id", F.lit(1).alias("leaf"))
    members = plans.select("conv_id", "n_turns").join(not_owned, "conv_id", "left").join(leaves, "conv_id", "left")
    members = members.select(
        "conv_id", "n_turns", F.coalesce("free", F.lit(0)).alias("free"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    paths = shared.select("conv_id", *_KEY, "before").unionByName(
        plans.select("conv_id", *zero, F.lit(0).cast("long").alias("before"))
    )
    sums = (
        paths.join(members, "conv_id")
        .groupBy(*_KEY)
        .agg(
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.greatest(F.lit(0), F.col("free") - F.col("before"))).alias("saved_tokens"),
        )
    )
    ends = shared.where("is_end = 1 and n_ends > 1").select(*_KEY, "conv_id").unionByName(
        plans.where("n_turns = 0").select(*zero, "conv_id")
    )
    hashes = _ends_hash(ends)
    first = plans.agg(F.min("conv_id")).first()[0]
    above = shared.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner"))
    found = all_nodes.join(sums, _KEY, "left").join(hashes, _KEY, "left").join(above, ["conv_id", "depth"], "left")
    one = F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")).cast("binary"), 256)
    parent_conv = F.when(F.col("depth") == 1, F.lit(first)).when(
        F.col("depth") > 1, F.coalesce("owner", "conv_id")
    )
    return found.select(
        "conv_id",
        "depth",
        parent_conv.cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.when(F.col("n_ends") > 1, F.col("ends_hash")).otherwise(one).alias("ends_sha256"),
    )
