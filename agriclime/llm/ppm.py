"""Language identification by prediction by partial matching.

For every language a context tree over bytes is counted on all learning texts (contexts
of 3, 2, 1 and 0 bytes, zero bytes before a text's start). The statistics are then
frozen. A byte seen ``n`` times after a context with ``N`` bytes of ``q`` kinds has the
probability ``n / (N + q)``; the rest, ``q / (N + q)``, is the escape to the next shorter
context, whose probabilities are renormalised over the bytes not seen here (exclusion);
below the empty context all 256 bytes are equally likely. A text's code length in a
language is the sum of ``-log2 p`` of its bytes; the shortest code wins.

Counting covers all learning texts and no context is thrown away. The code lengths of the
bytes seen after a context, and its escape, are what a table holds; contexts are cut into
shards by their last two bytes, each of at most ``shard_bytes``, and the texts pass over one
shard at a time. A usual model is one shard; a larger one takes more passes, never more
memory. Contexts of at most one byte are in every shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.llm.common import flat, quoted, steps, without
from agriclime.sources.tables import materialize

UNKNOWN = "und"
SHARD_BYTES = 32 << 20
_WIDEST = 3
_PIECE = 1 << 18  # places scored at once


def contexts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The three bytes before each byte as a number; zeros before a text's start."""
    out = np.zeros(len(data), np.uint32)
    first, last = starts[:-1], starts[1:]
    for back in range(1, _WIDEST + 1):
        shifted = np.zeros(len(data), np.uint32)
        shifted[back:] = data[:-back] if len(data) > back else 0
        for i in range(back):
            at = first + i
            shifted[at[at < last]] = 0
        out |= shifted << np.uint32(8 * (back - 1))
    return out


def _count(batches):
    """(language, four bytes) counts of a partition."""
    seen: dict[str, list] = {}

    def add(lang, keys, n):
        old = seen.setdefault(lang, [])
        old.append((keys, n))
        if len(old) >= 16:
            seen[lang] = [_merged(old)]

    for batch in batches:
        for part in steps(batch, "text"):
            langs = part.column("lang").dictionary_encode()
            codes = np.asarray(langs.indices)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                data, starts = flat(part.column("text").filter(pa.array(codes == code)))
                keys = (contexts(data, starts) << np.uint32(8)) | data
                add(lang, *np.unique(keys, return_counts=True))
    for lang, parts in seen.items():
        keys, n = _merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
            ["lang", "key", "n"],
        )


def _merged(parts):
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


@dataclass
class Order:
    """Contexts of one length: sorted (context, byte) keys and contexts, language x each."""

    keys: np.ndarray
    bits: np.ndarray  # code length of the byte
    contexts: np.ndarray
    escape: np.ndarray  # bits added to the code length after the next shorter context


@dataclass
class Shard:
    languages: list[str]
    low: int  # last two bytes of its contexts, from here to before ``high``
    high: int
    short: np.ndarray  # language x (byte before, byte): code length after at most one byte
    orders: list[Order]  # contexts of 2 and of 3 bytes


@dataclass
class Model:
    languages: list[str]
    counts: DataFrame  # (order, context, low, byte, lang, n)
    cuts: list[int]  # borders of the shards

    def shards(self) -> Iterator[Shard]:
        for low, high in zip(self.cuts, self.cuts[1:]):
            wanted = self.counts.where(f"order < 2 or (low >= {low} and low < {high})")
            found = wanted.select("order", "context", "byte", "lang", "n").toArrow()
            yield _shard(self.languages, low, high, found)


def _node(n: np.ndarray, owner: np.ndarray, count: int, shorter: np.ndarray):
    """Probabilities of (context, byte) cells and each context's escape factor.

    ``n`` and ``shorter`` (counts, and probabilities after the shorter context) are language
    x cell, ``owner`` is each cell's context.
    """
    p, factor = np.empty(n.shape), np.empty((len(n), count))
    for k, own in enumerate(n):
        seen = own > 0
        total = np.bincount(owner, own, count)
        q = np.bincount(owner[seen], minlength=count)
        rest = np.maximum(1 - np.bincount(owner[seen], shorter[k][seen], count), 1e-12)
        factor[k] = np.where(total > 0, q / np.maximum(total + q, 1) / rest, 1)
        p[k] = np.where(seen, own / np.maximum(total + q, 1)[owner], factor[k][owner] * shorter[k])
    return p, factor


def _shard(languages: list[str], low: int, high: int, found: pa.Table) -> Shard:
    order, context, byte, n = (np.asarray(found[c], np.int64) for c in ("order", "context", "byte", "n"))
    names = found["lang"].combine_chunks().dictionary_encode()
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[np.asarray(names.indices)]
    cells = (context << 8) | byte
    p = np.full((len(languages), 256), 1 / 256)
    for k in (0, 1):
        own = order == k
        counts = np.zeros((len(languages), 256 << 8 * k))
        counts[lang[own], cells[own]] = n[own]
        p, _ = _node(counts, np.arange(256 << 8 * k) >> 8, 1 << 8 * k, np.tile(p, 256**k))
    short, keys, orders = p, np.arange(1 << 16), []
    for k in (2, 3):
        own = order == k
        shorter_keys = keys
        keys, at = np.unique(cells[own], return_inverse=True)
        counts = np.zeros((len(languages), len(keys)))
        counts[lang[own], at] = n[own]
        nodes, owner = np.unique(keys >> 8, return_inverse=True)
        # A byte seen after a context was seen after each shorter one, so all keys are found.
        p, factor = _node(counts, owner, len(nodes), p[:, np.searchsorted(shorter_keys, keys & ((1 << 8 * k) - 1))])
        bits = [-np.log2(x).astype(np.float32) for x in (p, factor)]
        orders.append(Order(keys.astype(np.uint32), bits[0], nodes.astype(np.uint32), bits[1]))
    return Shard(languages, low, high, -np.log2(short).astype(np.float32), orders)


def learn(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model | None:
    """A model of all rows of (text, lang); null texts and languages teach nothing."""
    known = texts.select("text", "lang").where("text is not null and lang is not null")
    grams = known.mapInArrow(_count, "lang string, key long, n long")
    grams = materialize(grams.groupBy("lang", "key").agg(F.sum("n").alias("n")), "ppm-grams")
    level = [
        F.struct(F.lit(k).alias("order"), F.expr(f"(key >> 8) & {(1 << 8 * k) - 1}").alias("context"))
        for k in range(_WIDEST + 1)
    ]
    levels = (
        grams.select("lang", (F.col("key") % 256).alias("byte"), "n", F.explode(F.array(*level)).alias("c"))
        .groupBy("c.order", "c.context", "byte", "lang")
        .agg(F.sum("n").alias("n"))
        .withColumn("low", F.col("context").bitwiseAND(F.lit((1 << 16) - 1)))
    )
    counts = materialize(levels.repartitionByRange("low").sortWithinPartitions("low"), "ppm-counts")
    languages = sorted(r["lang"] for r in counts.where("order = 0").select("lang").distinct().collect())
    if not languages:
        return None
    sizes = counts.where("order > 1").select("low", "order", "context", "byte").distinct().groupBy("low")
    sizes = sizes.count().orderBy("low").collect()  # at most 2^16 rows
    cuts, held = [0], 0
    for r in sizes:
        own = 8 * r["count"] * (1 + len(languages))  # a key or context, and its bits by language
        if held and held + own > shard_bytes:
            cuts.append(r["low"])
            held = 0
        held += own
    return Model(languages, counts, [*cuts, 1 << 16])


def _find(sorted_keys: np.ndarray, wanted: np.ndarray):
    """Place of each wanted key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def code_lengths(shard: Shard, texts: pa.Array) -> np.ndarray:
    """Bits of each text (first axis) in each language, of the bytes whose context is in the shard."""
    data, starts = flat(texts)
    out = np.zeros((len(starts) - 1, len(shard.languages)))
    before = contexts(data, starts)
    for begin in range(0, len(data), _PIECE):
        context = before[begin : begin + _PIECE]
        low = context & np.uint32(0xFFFF)
        inside = np.flatnonzero((low >= shard.low) & (low < shard.high))
        if not len(inside):
            continue
        at = inside + begin
        text = np.searchsorted(starts, at, "right") - 1
        bits = _bits(shard, context[inside], data[at].astype(np.uint32))
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[heads]] += np.add.reduceat(bits, heads, axis=1, dtype=np.float64).T
    return out


def _bits(shard: Shard, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Language x place: code length after the longest context, over the escapes it takes."""
    out = np.zeros((len(shard.languages), len(context)), np.float32)
    left = np.arange(len(context))
    for k, order in ((3, shard.orders[1]), (2, shard.orders[0])):
        own = context[left] & np.uint32((1 << 8 * k) - 1)
        at, there = _find(order.keys, (own << np.uint32(8)) | byte[left])
        found = left[there]
        for row, bits in zip(out, order.bits):
            row[found] += bits[at[there]]
        left, own = left[~there], own[~there]
        at, there = _find(order.contexts, own)
        escaped = left[there]
        for row, bits in zip(out, order.escape):
            row[escaped] += bits[at[there]]
    cell = ((context[left] & np.uint32(255)) << np.uint32(8)) | byte[left]
    for row, bits in zip(out, shard.short):
        row[left] += bits[cell]
    return out


def _passes(df: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: bits in each language, summed over all shards."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    for turn, shard in enumerate(model.shards()):
        shared = df.sparkSession.sparkContext.broadcast(shard)

        def run(batches, shared=shared):
            for batch in batches:
                for part in steps(batch, text):
                    bits = code_lengths(shared.value, part.column(text)).ravel()
                    if name in part.schema.names:
                        bits = bits + np.asarray(part.column(name).flatten())
                    ends = pa.array(np.arange(part.num_rows + 1) * len(shared.value.languages), pa.int32())
                    added = pa.ListArray.from_arrays(ends, pa.array(bits))
                    kept = [c for c in part.schema.names if c != name]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), added], [*kept, name])

        if turn:
            df = materialize(df, "ppm-bits")
        df = df.mapInArrow(run, schema)
    return df


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (the winner's share, equal priors) and ``bits``.

    ``bits`` is the winning code length. ``und`` with score 0 for a null text, one without
    a letter, and if nothing was learned. Equal code lengths: the first language by name.
    """
    kept = without(df, ["lang_pred", "score", "bits"])
    rated = F.lit(None).cast("array<double>")
    known = F.lit(False)
    name = "_bits"
    while name in {c.lower() for c in kept.columns}:
        name += "_"
    names = F.array(F.lit(UNKNOWN))
    if model is not None:
        names = F.array(*map(F.lit, model.languages))
        full = _passes(kept, model, text, name)
        rated, known = F.col(name), F.coalesce(quoted(text).rlike(r"\p{L}"), F.lit(False))
    else:
        full = kept
    least = F.array_min(rated)
    share = 1 / F.aggregate(rated, F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), F.greatest(least - x, F.lit(-1000.0))))
    best = F.element_at(names, F.array_position(rated, least).cast("int"))
    return full.select(
        *[quoted(c) for c in kept.columns],
        F.when(known, best).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, share).otherwise(0.0).alias("score"),
        F.when(known, least).otherwise(0.0).alias("bits"),
    )


def learning_rows(documents: DataFrame, held_out: Column) -> DataFrame:
    return documents.where(~held_out & F.col("lang").isNotNull())
