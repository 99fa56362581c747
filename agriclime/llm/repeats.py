"""Exact repeated passages by suffix arrays: bytes covered by a string seen in an earlier text.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts in a document
of smaller ``doc_id``. Texts that equal another whole text are settled at once. For all
other texts:

1. Every window of ``LENGTH`` bytes has an anchor, the least hash of its ``GRAM``-byte
   pieces. Equal windows have equal anchors; runs of windows with one anchor are segments.
2. Anchors meet by hash in packed blocks. Those that occur once are dropped. So are those
   that no other document has between equal bytes: a window reaches ``SIDE`` bytes beyond
   its anchor on one side at least, so equal windows agree in the bytes there. A fraction
   of the text is left.
3. The texts of the other segments are cut out, equal segments become one row with the
   least document, and each anchor's different segments are sorted together: their suffix
   array (``suffixes``) puts equal windows side by side, and gives each the least document.
   An anchor with one segment, or with segments of one document, needs no sorting. Segments
   of an anchor that has more than ``VARIANTS`` are cut again, by anchors of longer pieces
   (``FINER``), and go the same way, so no task gets them whole. Pieces of ``LENGTH`` bytes
   are whole windows, which need no sorting at all.
4. Windows of a smaller document go back to all texts that hold the segment.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agriclime.llm.common import discard, flat, small, steps, store
from agriclime.llm.hashing import mix, prefix, span_hash
from agriclime.llm.suffixes import suffix_arrays

LENGTH = 50
GRAM = 16
FINER = (33, LENGTH)
RUN = 200  # windows of a segment at most
VARIANTS = 200
SIDE = (LENGTH - GRAM) // 2  # bytes that every window has before or after its anchor
BLOCK_ROWS = 400_000
HELD_ROWS = 5 * BLOCK_ROWS  # whose sides one task compares; beyond them anchors alone count
_BATCH = 1 << 20
_TEXT = 1 << 18  # bytes of text whose arrays still fit a core's cache
_PACK = np.dtype([("hash", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("count", "<i2"), ("before", "<u2"), ("after", "<u2")])
_FOUND = ["hash", "doc", "start", "count"]
_NONE, _ANY = 0, 65535  # instead of a side's hash: no window has that side; windows with several anchors


def segments(data: np.ndarray, starts: np.ndarray, gram: int = GRAM):
    """(anchor, text, first window, windows) of every segment of all texts."""
    return _segments(data, starts, gram)[:4]


def _segments(data: np.ndarray, starts: np.ndarray, gram: int):
    """What ``segments`` returns, the prefix sums of the bytes and the hashes of all pieces."""
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 4 + (prefix(data), np.zeros(0, np.uint64))
    at = np.arange(len(data) - gram + 1)
    sums = prefix(data)
    pieces = least = span_hash(sums, at, at + gram)
    span, width = 1, LENGTH - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    inside = np.zeros(windows + 1, np.int32)
    full = np.flatnonzero(np.diff(starts) >= LENGTH)
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, starts[full + 1] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    fresh = np.ones(windows, bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[starts[full]] = True
    fresh[1:] |= valid[1:] & ~valid[:-1]
    begin = np.flatnonzero(fresh & valid)
    stops = np.append(np.flatnonzero(fresh | ~valid), windows)
    end = stops[np.searchsorted(stops, begin, "right")]
    parts = -(-(end - begin) // RUN)  # long runs (periodic text) are cut; windows stay whole
    which = np.repeat(np.arange(len(begin)), parts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = begin[which] + number * RUN
    count = np.minimum(end[which] - first, RUN)
    text = np.searchsorted(starts, first, "right") - 1
    return least[first].view(np.int64), text, first, count, sums, pieces


def _sides(anchor: np.ndarray, first: np.ndarray, count: np.ndarray, sums: np.ndarray, pieces: np.ndarray):
    """Hashes of the ``SIDE`` bytes before and after every segment's anchor, in 16 bits.

    A window's anchor is the first piece of its hash. Segments in which it is not the same
    for all windows (periodic text) have ``_ANY`` for both.
    """
    place = np.full(len(first), -1)
    todo = np.arange(len(first))
    for i in range(LENGTH - GRAM + 1):
        found = pieces[first[todo] + i] == anchor[todo].view(np.uint64)
        place[todo[found]] = first[todo[found]] + i
        todo = todo[~found]
    last = first + count - 1
    sides = []
    for held, begin in ((first <= place - SIDE, place - SIDE), (last >= place - (LENGTH - GRAM - SIDE), place + GRAM)):
        own = np.flatnonzero(held)
        side = np.full(len(first), _NONE, np.uint16)
        side[own] = 1 + span_hash(sums, begin[own], begin[own] + SIDE) % np.uint64(_ANY - 1)
        side[place < last] = _ANY
        sides.append(side)
    return sides


def _blocks(count: int):
    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", _TEXT):
                data, starts = flat(part.column("text"))
                anchor, text, first, windows, sums, pieces = _segments(data, starts, GRAM)
                rows = np.empty(len(anchor), _PACK)
                rows["before"], rows["after"] = _sides(anchor, first, windows, sums, pieces)
                rows["hash"], rows["doc"] = anchor, np.asarray(part.column("doc_id"))[text]
                rows["start"], rows["count"] = first - starts[text], windows
                block = (anchor.view(np.uint64) >> np.uint64(20)) % np.uint64(count)
                order = np.argsort(block, kind="stable")
                bounds = np.searchsorted(block[order], np.arange(count + 1, dtype=np.uint64))
                rows = rows[order]
                full = np.flatnonzero(np.diff(bounds))
                packed = [rows[bounds[b] : bounds[b + 1]].tobytes() for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(packed, pa.binary())], ["block", "rows"])

    return run


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether rows of several documents have each row's key."""
    order = np.lexsort((doc, key))
    own, docs = key[order], doc[order]
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    counts = np.diff(np.append(heads, len(own)))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(docs[heads] != docs[heads + counts - 1], counts)
    return out


def _between_equal_bytes(rows: np.ndarray) -> np.ndarray:
    """The rows whose anchor another document has between bytes that agree on one side."""
    rows = rows[np.argsort(rows["hash"], kind="stable")]
    group = np.cumsum(np.append(False, rows["hash"][1:] != rows["hash"][:-1])[: len(rows)])
    several = np.bincount(group, minlength=1)[group] > 1
    rows, group = rows[several], group[several]
    doc = rows["doc"].copy()
    periodic = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    periodic[group[rows["before"] == _ANY]] = True
    used = periodic[group] & _several(group, doc)
    for side in ("before", "after"):
        own = rows[side].astype(np.int64)
        used |= (own != _NONE) & _several(group << 16 | own, doc)
    return rows[used]


def _found(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c].copy()) for c in _FOUND], _FOUND)


def _repeated(batches):
    """Rows whose windows may come up again in another document."""
    blobs = (np.frombuffer(blob.as_buffer(), _PACK) for batch in batches for blob in batch.column("rows"))
    waiting, held = [], 0
    for rows in blobs:
        waiting.append(rows)
        held += len(rows)
        if held > HELD_ROWS:
            yield from _streamed(chain(waiting, blobs))
            return
    if held:
        yield _found(_between_equal_bytes(np.concatenate(waiting)))


def _streamed(blobs):
    """Rows whose anchor comes up again, in a stream: one row is remembered per anchor."""
    known = np.empty(0, _PACK)
    told = np.empty(0, bool)
    waiting: list[np.ndarray] = []

    def merged():
        nonlocal known, told
        rows = np.concatenate(waiting)
        waiting.clear()
        rows = rows[np.argsort(rows["hash"], kind="stable")]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = rows["hash"][1:] != rows["hash"][:-1]
        heads = np.flatnonzero(fresh)
        counts = np.diff(np.append(heads, len(rows)))
        place = np.searchsorted(known["hash"], rows["hash"][heads])
        old = place < len(known)
        old[old] = known["hash"][place[old]] == rows["hash"][heads[old]]
        again = old | (counts > 1)
        out = [rows[np.repeat(again, counts)]]
        late = place[old]
        late = late[~told[late]]
        out.append(known[late])
        told[late] = True
        new = heads[~old]
        known = np.concatenate([known, rows[new]])
        told = np.concatenate([told, counts[~old] > 1])
        order = np.argsort(known["hash"], kind="stable")
        known, told = known[order], told[order]
        return _found(np.concatenate(out))

    held = 0
    for rows in blobs:
        waiting.append(rows)
        held += len(rows)
        if held >= max(BLOCK_ROWS, len(known) // 4):
            held = 0
            yield merged()
    if waiting:
        yield merged()


def _cut_out(batches):
    for batch in batches:
        for part in steps(batch, "text", 1 << 20):
            data, starts = flat(part.column("text"))
            spans = part.column("spans")
            owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(spans.offsets)))
            rows = spans.flatten()
            start, count = (np.asarray(rows.field(c)).astype(np.int64) for c in ("start", "count"))
            raw = data.tobytes()
            begin = starts[owner] + start
            texts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.field("hash"), pa.array(np.asarray(part.column("doc_id"))[owner]), rows.field("start"), pa.array(texts, pa.binary())],
                ["hash", "doc", "start", "segment"],
            )


def _finer(gram: int):
    """Segments cut again by anchors of ``gram`` bytes; ``whole`` and ``at`` tell where a piece lies."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "segment"):
                data, starts = flat(part.column("segment"))
                anchor, text, first, windows = segments(data, starts, gram)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(first.tolist(), (first + windows + LENGTH - 1).tolist())]
                above = np.asarray(part.column("hash"))[text]
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mix(anchor.view(np.uint64) ^ mix(above.view(np.uint64))).view(np.int64)),
                        pa.array(texts, pa.binary()),
                        part.column("doc").take(own), part.column("most").take(own),
                        pa.array(above), part.column("sid").take(own), pa.array((first - starts[text]).astype(np.int32)),
                    ],
                    ["hash", "segment", "doc", "most", "whole_hash", "whole_sid", "at"],
                )

    return run


def least_documents(anchor: np.ndarray, data: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of every window of all pieces in a row, among pieces of its anchor.

    Piece ``i`` has ``size[i]`` bytes of ``data``; pieces of one anchor stand together and
    make one text of the batch.
    """
    fresh = np.ones(len(size), bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    # Symbols: bytes from 2 on, 1 after every piece, 0 at a text's end.
    extra = 1 + np.append(fresh[1:], True).astype(np.int64)
    begin = np.cumsum(size + extra) - size - extra
    symbols = np.zeros(int((size + extra).sum()), np.int16)
    inner = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(data))
    symbols[inner] = data.astype(np.int16) + 2
    symbols[begin + size] = 1
    heads = np.flatnonzero(fresh)
    offsets = np.append(begin[heads], len(symbols))
    sa = suffix_arrays(symbols, offsets)
    owner = np.full(len(symbols), -1, np.int64)
    windows = size - LENGTH + 1
    places = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner[places] = np.repeat(np.arange(len(size)), windows)
    sa = sa[owner[sa] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)
    equal = np.zeros(len(sa), bool)
    for i in range(1, len(sa), 1 << 16):
        a, b = sa[i - 1 : i - 1 + (1 << 16)], sa[i : i + (1 << 16)]
        equal[i : i + len(b)] = (view[a[: len(b)]] == view[b]).all(1)
    text = np.searchsorted(offsets, sa, "right")
    equal[1:] &= text[1:] == text[:-1]
    runs = np.flatnonzero(~equal)
    value = np.empty(len(symbols), np.int64)
    value[sa] = np.repeat(np.minimum.reduceat(doc[owner[sa]], runs), np.diff(np.append(runs, len(sa))))
    return value[places]


def _answers(table: pa.Table) -> pa.RecordBatch:
    """Runs of windows of one least document, of segments that lose bytes somewhere."""
    anchor, doc, most = (np.asarray(table[c]) for c in ("hash", "doc", "most"))
    data, starts = flat(table["segment"])
    size = np.diff(starts)
    values = least_documents(anchor, data, size, doc)
    windows = size - LENGTH + 1
    begin = np.cumsum(windows) - windows
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[begin] = True
    heads = np.flatnonzero(fresh)
    piece = np.searchsorted(begin, heads, "right") - 1
    last = np.append(heads[1:], len(values)) - 1
    used = values[heads] < most[piece]
    heads, last, piece = heads[used], last[used], piece[used]
    kept, counts = np.unique(piece, return_counts=True)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = [
        pa.ListArray.from_arrays(ends, pa.array(x, t))
        for x, t in ((heads - begin[piece], pa.int32()), (last - begin[piece], pa.int32()), (values[heads], pa.int64()))
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[kept]), pa.array(np.asarray(table["sid"])[kept]), *lists], ["hash", "sid", "first", "last", "least"]
    )


def _sorted_groups(batches):
    """Least documents of the windows of all segments, whole anchors at a time."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column("segment").nbytes
        if size >= _BATCH:
            table = pa.Table.from_batches(waiting)
            anchor = np.asarray(table["hash"])
            whole = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
            if whole:
                yield _answers(table.slice(0, whole))
                waiting = table.slice(whole).to_batches()
                size = sum(b.column("segment").slice(0).nbytes for b in waiting)
    if waiting and sum(b.num_rows for b in waiting):
        yield _answers(pa.Table.from_batches(waiting))


def _cleaned(batches):
    for batch in batches:
        for part in steps(batch, "text", _TEXT):
            data, starts = flat(part.column("text"))
            size = np.diff(starts)
            cuts = part.column("cuts")
            lists, rows = cuts.value_lengths().fill_null(0), cuts.flatten()
            lo, hi = (np.asarray(rows.field(c)).astype(np.int64) for c in ("lo", "hi"))
            owner = np.repeat(np.arange(part.num_rows), np.asarray(lists))
            whole = np.flatnonzero(np.asarray(part.column("copy").fill_null(False)) & (size >= LENGTH))
            owner = np.concatenate([owner, whole])
            lo, hi = np.concatenate([lo, np.zeros(len(whole), np.int64)]) + starts[owner], np.concatenate([hi, size[whole]]) + starts[owner]
            order = np.lexsort((lo, owner))
            owner, lo, hi = owner[order], lo[order], hi[order]
            # Texts lie in a row, so no cut of an earlier text reaches into a later one.
            reached = np.maximum.accumulate(hi)
            fresh = np.ones(len(lo), bool)
            fresh[1:] = (lo[1:] > reached[:-1]) | (owner[1:] != owner[:-1])
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            stays = np.cumsum(edge[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(stays)])[starts]
            kept = pa.Array.from_buffers(
                pa.binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[stays])]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(size), pa.array(size - np.diff(left)),
                    pa.array(np.bincount(owner[fresh], minlength=part.num_rows)), kept,
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of ``df`` (doc_id, text).

    ``kept`` is the binary rest. A null text is empty. Rows without ``doc_id``, and texts of
    a repeated ``doc_id`` other than the one of least hash, neither lose bytes nor count as
    earlier; repeated equal rows are treated alike. Other columns are not read.
    """
    documents = df.select(F.col("doc_id").cast("long"), "text")
    keys = documents.where("doc_id is not null and text is not null")
    keys = keys.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.octet_length("text").alias("n"))
    keys = store(keys.distinct(), "keys")
    one = keys.groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("k")).select("doc_id", "k.h", "k.n")
    one = store(one, "one")
    lead = store(one.groupBy("h").agg(F.min("doc_id").alias("lead")), "lead")
    named = one.join(lead, "h").select("doc_id", "h", "n", (F.col("doc_id") > F.col("lead")).alias("copy"))
    named = store(named, "named")
    copies = store(named.where("copy").select("doc_id"), "copies")
    odd = store(keys.join(one, ["doc_id", "h"], "left_anti").select("doc_id", "h"), "odd")
    repeated = keys.count() < documents.count()
    discard(keys, one, lead)
    texts = documents.where(f"doc_id is not null and octet_length(text) >= {LENGTH}")
    texts = texts.join(small(copies), "doc_id", "left_anti")
    if odd.limit(1).count():
        texts = texts.withColumn("h", F.md5(F.col("text").cast("binary")))
        texts = texts.join(small(odd), ["doc_id", "h"], "left_anti").select("doc_id", "text")

    total = named.where("not copy").agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / 17 / BLOCK_ROWS))
    packed = texts.mapInArrow(_blocks(blocks), "block long, rows binary").repartition(blocks, "block")
    found = packed.mapInArrow(_repeated, "hash long, doc long, start int, count short")
    spans = found.groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list(F.struct("hash", "start", F.col("count").cast("int").alias("count"))).alias("spans")
    )
    spans = store(spans, "spans")
    pieces = texts.dropDuplicates(["doc_id", "text"]) if repeated else texts
    pieces = pieces.join(spans, "doc_id").mapInArrow(_cut_out, "hash long, doc long, start int, segment binary")
    pieces = store(pieces.withColumn("sid", F.xxhash64("segment")), "pieces")
    discard(copies, odd, spans)

    distinct = pieces.groupBy("hash", "segment", "sid").agg(F.min("doc").alias("doc"), F.max("doc").alias("most"))
    distinct = store(distinct, "segments")
    answers = _least_in_windows(distinct, FINER)
    run = F.explode(F.arrays_zip("first", "last", "least")).alias("run")
    cuts = pieces.select("hash", "sid", "doc", "start").join(answers, ["hash", "sid"])
    cuts = cuts.select("doc", "start", run).where("run.least < doc")
    cuts = cuts.groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_set(
            F.struct((F.col("start") + F.col("run.first")).alias("lo"), (F.col("start") + F.col("run.last") + LENGTH).alias("hi"))
        ).alias("cuts")
    )
    cuts = named.join(cuts, "doc_id", "left").where("copy or cuts is not null").select("doc_id", "h", "copy", "cuts")
    cuts = store(cuts, "cuts")
    discard(named, pieces, answers)
    keyed = documents.withColumn("h", F.md5(F.col("text").cast("binary")))
    return keyed.join(cuts, ["doc_id", "h"], "left").mapInArrow(
        _cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def _least_in_windows(distinct: DataFrame, finer: tuple[int, ...]) -> DataFrame:
    """(hash, sid, first, last, least) of the segments some of whose windows an earlier document has.

    ``distinct``: (hash, segment, sid, doc, most) of the different segments of each anchor with
    their least and greatest document; deleted when it is read. ``finer``: lengths of the
    pieces whose anchors cut the segments of a hot anchor again.
    """
    kinds = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("most").alias("high"))
    # An anchor that one document alone has takes nothing away.
    kinds = store(kinds.where("low < high").select("hash", "n"), "kinds")
    # Stored, as three branches read it: the segments are shuffled once for all of them.
    counted = store(distinct.join(kinds, "hash"), "counted")
    discard(distinct, kinds)
    windows = F.octet_length("segment") - LENGTH
    single = counted.where("n = 1 and most > doc").select(
        "hash", "sid", F.array(F.lit(0)).alias("first"), F.array(windows).alias("last"), F.array("doc").alias("least")
    )
    if not finer:
        answers = store(single, "single")
        discard(counted)
        return answers
    several = counted.where(f"n > 1 and n <= {VARIANTS}").select("n", "hash", "segment", "doc", "most", "sid")
    # Anchors of about as many segments take their steps together.
    ordered = several.repartition("hash").sortWithinPartitions("n", "hash")
    ordered = ordered.mapInArrow(_sorted_groups, "hash long, sid long, first array<int>, last array<int>, least array<long>")
    # Each in a step of its own, so that the shuffle files of one go before the next begins.
    parts = [store(part, label) for part, label in ((single, "single"), (ordered, "sorted"))]
    hot = counted.where(f"n > {VARIANTS}")
    if hot.limit(1).count():
        schema = "hash long, segment binary, doc long, most long, whole_hash long, whole_sid long, at int"
        pieces = hot.select("hash", "segment", "doc", "most", "sid").mapInArrow(_finer(finer[0]), schema)
        pieces = store(pieces.withColumn("sid", F.xxhash64("segment")), "finer")
        own = pieces.groupBy("hash", "segment", "sid").agg(F.min("doc").alias("doc"), F.max("most").alias("most"))
        own = store(own, "segments")
        found = _least_in_windows(own, finer[1:])
        shifted = [F.transform(c, lambda i: i + F.col("at")).alias(c) for c in ("first", "last")]
        back = pieces.select("hash", "sid", "whole_hash", "whole_sid", "at").join(found, ["hash", "sid"])
        back = back.select(F.col("whole_hash").alias("hash"), F.col("whole_sid").alias("sid"), *shifted, "least")
        parts.append(store(back, "hot"))
        discard(pieces, found)
    discard(counted)
    answers = parts[0]
    for part in parts[1:]:
        answers = answers.unionByName(part)
    answers = store(answers, "answers")
    discard(*parts)
    return answers
