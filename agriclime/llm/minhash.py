"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct five-word shingles (all words as one
where there are fewer). A sketch has ``BINS`` bins. In round ``i`` every shingle is thrown
into a hashed bin with a value that starts at ``i``; a bin keeps its least value, so later
rounds only fill bins that are still empty, and from round ``BINS`` on round ``i`` fills
bin ``i - BINS`` outright: every coordinate fills, and agreeing bins estimate the
similarity with the concentration of independent draws. Sketches are cut into ``BANDS``
bands of ``ROWS`` bins. Two sets of similarity 0.75 share no band with a probability of
about (1 - 0.75^4)^32, 5 in a million.

Texts of equal words are one node. Members of a band are compared by pivots (``buckets``)
on the full shingle sets. Where many sets of one band are left that are just too far from
each other, they are told apart by parity marks: a mark has ``MARK`` bits, each the parity
of the shingles that fall on it, so bits in which two marks differ are at most as many as
shingles that only one of the sets has. Linked sets cannot differ in more shingles than a
share of their sizes, whatever the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agriclime.llm.buckets import linked
from agriclime.llm.common import flat, small, steps
from agriclime.llm.hashing import LOWER, mix, prefix, seeds, span_hash, words
from agriclime.sources.tables import materialize

BINS, BANDS, ROWS = 128, 32, 4
WORDS = 5
PERCENT = 75
MARK = 1024
_EMPTY = np.uint64(2**64 - 1)
_PLACES = seeds(WORDS, 2) | np.uint64(1)
_SHORT = seeds(WORDS, 3)
_ROUNDS = seeds(2 * BINS, 4)
_BAND = seeds(BANDS, 5)
_CELL = seeds(ROWS, 6) | np.uint64(1)


def shingle_sets(texts: pa.Array):
    """Sorted distinct shingle hashes of all texts in a row, their starts, and word-sequence hashes."""
    data, starts = flat(texts)
    data = LOWER[data]
    begin, end, first = words(data, starts)
    word = span_hash(prefix(data), begin, end)
    n = len(starts) - 1
    many = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        many += word[k : k + len(many)] * _PLACES[k]
    many = mix(many)
    sets, sizes = [], np.zeros(n, np.int64)
    sequence = np.zeros(n, np.uint64)
    place = np.arange(len(word), dtype=np.uint64)
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            continue
        sequence[i] = np.bitwise_xor.reduce(mix(word[a:b] + (place[: b - a] + np.uint64(1)) * _PLACES[0]))
        if b - a < WORDS:
            own = np.array([sequence[i] ^ _SHORT[b - a]])
        else:
            own = np.sort(many[a : b - WORDS + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sets.append(own)
        sizes[i] = len(own)
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return joined, np.concatenate([[0], np.cumsum(sizes)]), sequence


def sketches(shingles: np.ndarray, starts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` numbers (a power of two) for each set; rows of empty sets hold no value."""
    n = len(starts) - 1
    shift = np.uint64(65 - bins.bit_length())
    out = np.full(n * bins, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(starts))
    for turn in range(2 * bins):
        if not len(owner):
            break
        x = mix(shingles ^ _ROUNDS[turn])
        cell = (x >> shift).astype(np.int64) if turn < bins else turn - bins
        value = (np.uint64(turn) << np.uint64(56)) | (x & np.uint64(2**56 - 1))
        np.minimum.at(out, owner * bins + cell, value)
        open_rows = (out.reshape(n, bins) == _EMPTY).any(1)[owner]
        shingles, owner = shingles[open_rows], owner[open_rows]
    return out.reshape(n, bins)


def bands(sketch: np.ndarray) -> np.ndarray:
    cells = sketch.reshape(len(sketch), BANDS, ROWS)
    return mix((cells * _CELL).sum(2, dtype=np.uint64) ^ _BAND)


def _sketched(batches):
    for batch in batches:
        for part in steps(batch, "text"):
            shingles, starts, sequence = shingle_sets(part.column("text"))
            keys = bands(sketches(shingles, starts)).astype(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("hash"), pa.array(np.diff(starts)), pa.array(sequence.view(np.int64)), lists],
                ["doc_id", "hash", "n_shingles", "node", "bands"],
            )


def parity_marks(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each set's parity bits (set x word of 64)."""
    width = MARK // 64
    place = shingles >> np.uint64(65 - MARK.bit_length())
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = np.zeros((len(starts) - 1) * width, np.uint64)
    word = owner * width + (place >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(-1, width)


def _marked(batches):
    for batch in batches:
        for part in steps(batch, "text"):
            found = parity_marks(*shingle_sets(part.column("text"))[:2])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "mark"])


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _confirmed(batches):
    last: tuple = (None, None)
    for batch in batches:
        for part in steps(batch, "text_b", 1 << 20):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            right, at, _ = shingle_sets(part.column("text_b"))
            alike, apart = np.zeros(len(a), bool), np.zeros(len(a))
            for i in range(len(a)):
                if last[0] != a[i]:
                    last = (a[i], shingle_sets(part.column("text_a").slice(i, 1))[0])
                both, either = overlap(last[1], right[at[i] : at[i + 1]])
                alike[i] = 100 * both >= PERCENT * either
                apart[i] = 1 - both / either
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(alike), pa.array(apart)], ["a", "b", "alike", "apart"]
            )


def near_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``df`` (doc_id long, text).

    Rows without words have an empty set and link with nothing, as rows without ``doc_id``
    do (their ``component_id`` is null and they are kept). Repeated rows share a component.
    Other columns are not read.
    """
    # An id may be repeated with another text: a node's text is told by both.
    documents = df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    rows = documents.mapInArrow(_sketched, "doc_id long, hash long, n_shingles long, node long, bands array<long>")
    rows = materialize(rows, "sketches")
    texts = rows.where("n_shingles > 0 and doc_id is not null").groupBy("node")
    texts = texts.agg(F.min(F.struct("doc_id", "hash")).alias("of"), F.first("n_shingles").alias("n"))
    texts = materialize(texts.select("node", "of.doc_id", "of.hash", "n"), "texts")
    one = rows.join(texts.drop("n"), ["doc_id", "hash", "node"]).dropDuplicates(["node"])
    members = one.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("info"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(texts.join(nodes, "node").select("node", "doc_id", "hash"), "wanted")
        found = documents.join(small(wanted), ["doc_id", "hash"]).where("text is not null")
        return materialize(found.select("node", "text").dropDuplicates(["node"]), "wanted-texts")

    def marks(nodes: DataFrame) -> DataFrame:
        return materialize(texts_of(nodes).mapInArrow(_marked, "node long, mark array<long>"), "marks")

    def confirm(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            own = texts.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"))
            pairs = pairs.join(own, side)
        alike = F.expr(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
        pairs = materialize(pairs.where(alike).select("a", "b"), "sized-pairs")
        found = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        left = found.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = found.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return both.sortWithinPartitions("a").mapInArrow(_confirmed, "a long, b long, alike boolean, apart double")

    larger = f"100 * least(x.info, y.info) >= {PERCENT} * greatest(x.info, y.info)"
    # Sets of sizes s and t that differ in d shingles share (s + t - d) / 2 of (s + t + d) / 2.
    bits = " + ".join(f"bit_count(x.mark[{i}] ^ y.mark[{i}])" for i in range(MARK // 64))
    close = f"{100 + PERCENT} * ({bits}) <= {100 - PERCENT} * (x.info + y.info)"
    names = linked(members, confirm, larger, 1 - PERCENT / 100 + 1e-9, marks, close)
    if names is None:
        names = texts.select("node", F.col("node").alias("component")).limit(0)
    slim = rows.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    slim = materialize(slim.withColumn("component", F.coalesce("component", "node")), "named")
    takes_part = F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    least = slim.where(takes_part).groupBy("component").agg(F.min("doc_id").alias("least"))
    least = materialize(least, "least")
    return slim.join(least, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.when(takes_part, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
