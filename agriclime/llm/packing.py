"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the capacity, so the plan needs only how many pieces have
each length: one small table, however many documents there are. Large lengths are cut into
groups of equal cardinality and rounded up to the largest of their group; for these few
sizes the best mix of fillings is a linear program, solved by column generation. Whole
multiples of its fillings are used, the actual lengths take the places of the rounded ones,
and all other pieces, longest first, go where they fit best.

The plan says where the r-th piece of a length goes, in runs of equal fillings. Spark numbers
the pieces of each length by a range sort, so no task and no group holds all of a length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from agriclime.llm.bpe import WORDS, Vocabulary
from agriclime.llm.common import small, steps
from agriclime.sources.tables import materialize

CAPACITY = 1024
END_ID = 2
# A long text is encoded in slices of about so many characters, cut where words are.
SLICE = 1 << 20
# Plans to choose from, by number of groups and by the part of the capacity above which
# lengths are large; the one with the fewest sequences is taken.
GROUPINGS = ((32, 1 / 8), (64, 1 / 8), (64, 1 / 4), (64, 1 / 3), (64, 1 / 2))
# Column generation ends when no filling is worth so much more than one sequence.
TOLERANCE = 1e-3

PIECE = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


def ranks_suffice(content: str) -> bool:
    """Whether merging any two neighbours that form a token, in the order of ids, is exact.

    The file lists merges of pairs. It is exact if ids follow the merges' order and if no
    other pair with the same bytes as a token can ever stand side by side, whole, when that
    token's turn comes; this holds for the 50k vocabulary.
    """
    vocabulary = Vocabulary.read(content)
    born = vocabulary.born
    merged = np.flatnonzero(born >= 0)
    if len(merged) != len(vocabulary.merges) or (np.diff(born[merged]) <= 0).any():
        return False
    other = [
        (a, b, born[t])
        for piece, t in vocabulary.ids.items()
        for k in range(1, len(piece))
        if (a := vocabulary.ids.get(piece[:k])) is not None
        and (b := vocabulary.ids.get(piece[k:])) is not None
        and (a, b) not in vocabulary.merges
    ]
    if not other:
        return True
    a, b, until = np.array(other, np.int64).T
    made = vocabulary.reachable()
    return not (vocabulary._border(a, b, until) & made[a] & made[b]).any()


def slices(text: str, size: int) -> Iterator[str]:
    """``text`` in parts that encode alone as they do together: cut at single blanks."""
    start = 0
    blank = regex.compile(r"(?<=\S) (?=\S)")
    while len(text) - start > size and (found := blank.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them without special tokens added.

    Where ``by_rank`` (see ``ranks_suffice``) the same ids come from tiktoken, some five
    times as fast; special tokens in a text become their ids in both.
    """

    def __init__(self, content: str, by_rank: bool):
        self.exact, self.fast = None, None
        vocabulary = Vocabulary.read(content) if by_rank else None
        if vocabulary:
            self.fast = tiktoken.Encoding(
                "vocabulary", pat_str=WORDS, mergeable_ranks=vocabulary.ids, special_tokens=vocabulary.special
            )
        else:
            self.exact = Tokenizer.from_str(content)
            self.exact.no_truncation()
            self.exact.no_padding()

    def encode(self, text: str) -> np.ndarray:
        if self.exact:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        parts = [self.fast.encode_to_numpy(part, allowed_special="all") for part in slices(text, SLICE)]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def pieces(
    df: DataFrame,
    content: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of every document's ids and ``end_id``: ``key``, ``piece``, ``start``,
    ``length``, ``ids_crc32``, and ``ids`` (packed little-endian 32-bit) if asked for.

    A document longer than ``capacity`` is cut from its end, so that the first piece is the
    shorter one. A null text is an empty one: one piece of one token. Repeated rows are
    documents of their own; other columns are not read.
    """
    by_rank = ranks_suffice(content)
    shared = df.sparkSession.sparkContext.broadcast(content)
    source = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    fields = [source.schema.fields[0], *PIECE] + [T.StructField("ids", T.BinaryType())] * keep_ids
    held: list[Encoder] = []

    def run(batches):
        if not held:
            held.append(Encoder(shared.value, by_rank))
        encode = held[0].encode
        for batch in batches:
            for part in steps(batch, "text"):
                owner, rows, packed = [], [], []
                for i, value in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode(value or ""), np.uint32(end_id)).astype("<u4", copy=False)
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(min(first, len(ids)), len(ids), capacity), len(ids)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        raw = ids[a:b].tobytes()
                        owner.append(i)
                        rows.append((n, a, b - a, zlib.crc32(raw)))
                        if keep_ids:
                            packed.append(raw)
                columns = [part.column(0).take(pa.array(owner, pa.int64()))]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns += [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                columns += [pa.array(packed, pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


@dataclass
class Plan:
    """Runs of places: the ``count`` pieces of a length from ``rank`` on go into sequences from
    ``sequence`` on, ``each`` of them side by side from ``offset`` on."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank, count, sequence, each, offset
    sequences: int = 0

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 6)


def fillings(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The fillings of a sequence, and how often to use each, that take the fewest sequences.

    Column generation: a filling that the current prices make worth more than one sequence
    comes in, found by an unbounded knapsack over the capacity, until there is none.
    """
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    amounts = inverse @ counts.astype(float)
    for turn in range(1, 40 * n):
        if turn % 200 == 0:  # rounding errors of the updates go
            inverse = np.linalg.inv(columns)
        prices = inverse.sum(0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for s in range(int(sizes[-1]), capacity + 1):
            at = int(np.searchsorted(-sizes, -s))  # sizes fall: those from here on fit
            worth = best[s - sizes[at:]] + prices[at:]
            top = int(worth.argmax())
            best[s] = best[s - 1]
            if worth[top] > best[s] + 1e-12:
                best[s], choice[s] = worth[top], at + top
        if best[capacity] <= 1 + TOLERANCE:
            break
        new, left = np.zeros(n), capacity
        while left > 0:
            if choice[left] < 0:
                left -= 1
                continue
            new[choice[left]] += 1
            left -= sizes[choice[left]]
        step = inverse @ new
        rises = step > 1e-9
        limits = np.full(n, np.inf)
        limits[rises] = amounts[rises] / step[rises]
        out = int(np.argmin(limits))
        most, pivot = limits[out], inverse[out] / step[out]
        amounts = np.maximum(amounts - most * step, 0)
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out], amounts[out] = new, most
    return [(columns[:, j].astype(np.int64), float(amounts[j])) for j in range(n)]


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = 64, large: float = 1 / 8) -> Plan:
    """Where the pieces of each length go; ``lengths`` says how many there are of each."""
    made = Plan()
    used: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (first sequence, how many)

    def place(length, count, sequence, each, offset):
        made.runs.append((length, used[length], count, sequence, each, offset))
        used[length] += count

    big = [(s, c) for s, c in sorted(lengths.items(), reverse=True) if s > large * capacity and c > 0]
    for sizes, mix in _grouped(big, capacity, groups):
        _substitute(made, place, room, sizes, mix, capacity)
    for s, c in sorted(lengths.items(), reverse=True):
        left = c - used[s]
        for free in range(s, capacity):
            while left and room[free]:
                first, many = room[free].pop()
                each = free // s
                whole = min(many, left // each)
                if whole:
                    place(s, whole * each, first, each, capacity - free)
                    room[free - each * s].append((first, whole))
                    left -= whole * each
                    first, many = first + whole, many - whole
                if many and left:
                    place(s, left, first, left, capacity - free)
                    room[free - left * s].append((first, 1))
                    first, many, left = first + 1, many - 1, 0
                if many:
                    room[free].append((first, many))
        while left:
            each = min(capacity // s, left)
            many = left // each
            place(s, many * each, made.sequences, each, 0)
            room[capacity - each * s].append((made.sequences, many))
            made.sequences += many
            left -= many * each
    return made


def _grouped(big, capacity: int, groups: int):
    """Groups of equal cardinality, each as a queue of (length, count), and their fillings."""
    total = sum(c for _, c in big)
    if not total:
        return
    queues: dict[int, list[list[int]]] = {}
    taken, size = 0, None
    for s, c in big:
        while c:
            group = taken * groups // total
            ends = -(-(group + 1) * total // groups)
            if size is None or taken == -(-group * total // groups):
                size = s
            part = min(c, ends - taken)
            queues.setdefault(size, []).append([s, part])
            taken, c = taken + part, c - part
    sizes = np.array(sorted(queues, reverse=True))
    counts = np.array([sum(c for _, c in queues[s]) for s in sizes])
    mix = [(filling, int(amount)) for filling, amount in fillings(sizes, counts, capacity)]
    # Fillings that leave the least room come first: their places are taken by the longest.
    mix.sort(key=lambda m: (-int((m[0] * sizes).sum()), m[0].tolist()))
    yield [queues[s] for s in sizes], mix


def _substitute(made: Plan, place, room, queues, mix, capacity: int) -> None:
    """Sequences of each filling, with actual lengths in the places of the rounded ones."""
    for filling, many in mix:
        slots, cuts = [], {0}
        for queue, n in zip(queues, filling):
            for _ in range(n):
                slot, at = [], 0
                while at < many and queue:
                    part = min(queue[0][1], many - at)
                    slot.append((at, at + part, queue[0][0]))
                    queue[0][1] -= part
                    at += part
                    cuts.add(at)
                    if not queue[0][1]:
                        queue.pop(0)
                if slot:
                    slots.append(slot)
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for slot in slots:
                for first, last, length in slot:
                    if first <= a < last:
                        place(length, b - a, made.sequences, 1, offset)
                        offset += length
            room[capacity - offset].append((made.sequences, b - a))
            made.sequences += b - a


def best_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    return min((plan(lengths, capacity, *g) for g in GROUPINGS), key=lambda p: p.sequences)


def pack(found: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; no sequence exceeds ``capacity``.

    ``found`` has ``key``, ``piece``, ``start``, ``length`` (1 to ``capacity``) and
    ``ids_crc32``; its other columns stay, those named ``sequence_id`` or ``offset`` are
    replaced. Pieces of one length are interchangeable and are numbered by ``key``,
    ``piece``, ``start`` and ``ids_crc32``, so equal tables give equal results. An empty
    table gives no rows.
    """
    found = found.drop("sequence_id", "offset", "_part", "_at")
    order = ["length", key, "piece", "start", "ids_crc32"]
    placed = found.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    placed = materialize(placed, "pieces-sorted")
    parts = placed.groupBy("length", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("least"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(
        parts.withColumn("_shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")), "lengths"
    )
    # At most one row for each length up to the capacity.
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_plan(lengths, capacity).arrays()
    shared = found.sparkSession.sparkContext.broadcast(runs)
    ranked = placed.join(small(parts.drop("n", "least")), ["length", "_part"]).withColumn(
        "_rank", F.col("_at") + F.col("_shift")
    )
    kept = found.columns
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def run(batches):
        runs = shared.value
        width = int(runs[:, 1].max(initial=0) + runs[:, 2].max(initial=0) + 1)
        starts = runs[:, 0] * width + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "_rank"))
            row = runs[np.searchsorted(starts, length * width + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, T.StructType([*found.schema.fields, *added]))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``n_tokens``, ``ids``.

    ``packed`` has ``ids`` (from ``pieces(keep_ids=True)``); a group holds one sequence.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", joined.alias("ids")
    )
