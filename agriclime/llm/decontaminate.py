"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: ASCII letters in lower case, every run of other
ASCII characters that are no letter or digit one blank. An item of ``m`` normalised bytes
has the error budget ``k = floor(rate * m)`` and is cut into ``k + 1`` pieces; a passage
within ``k`` edits holds at least one piece unchanged, so all piece hits of an automaton
are all candidates. Each is verified with Myers' bit-parallel edit distance around the
place where the item would lie, unless too few of the item's 4-grams lie there: an edit
breaks 4 of them at most, so no match is lost. Items under ``MIN_BYTES`` normalised bytes
are too general for edits: they match only as they are, between word borders.

Test items are handled in blocks of bounded size: each block's items are broadcast and
meet every text, so a benchmark of any size is searched whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.llm.common import append_columns, flat, quoted, without
from agriclime.llm.hashing import LOWER

RATE = 0.08
MIN_BYTES = 32
BLOCK_BYTES = 2 << 20
_GRAM = 4

_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def normalised(data: np.ndarray, starts: np.ndarray):
    """Normalised bytes of all texts, each after a zero byte, and the texts' starts there."""
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    other = _OTHER[data]
    run = np.zeros(len(data), bool)
    run[1:] = other[1:] & other[:-1]
    drop = other & (run | edge[:-1])  # a blank less at a text's start
    drop[1:] &= ~edge[1:-1] | other[1:]
    kept = ~drop
    out = np.where(other, np.uint8(32), LOWER[data])[kept]
    before = np.concatenate([[0], np.cumsum(kept)])
    at = before[starts]
    texts = len(starts) - 1
    padded = np.zeros(len(out) + texts, np.uint8)
    shift = np.repeat(np.arange(1, texts + 1), np.diff(at))
    padded[np.arange(len(out)) + shift] = out
    return padded, at + np.arange(texts + 1), kept


def normal(text: str) -> bytes:
    data = np.frombuffer(text.encode(), np.uint8)
    padded, _, _ = normalised(data, np.array([0, len(data)]))
    return padded[1:].tobytes().rstrip(b" ")


@dataclass
class Pattern:
    """Myers' automaton of one byte string; all its bits are one integer."""

    text: bytes
    masks: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        for i, c in enumerate(self.text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distances(self, text: bytes, anchored: bool = False):
        """Edit distance of the pattern to the best piece of ``text`` ending at each byte.

        ``anchored``: to the whole text up to there.
        """
        m = len(self.text)
        full, high = (1 << m) - 1, 1 << (m - 1)
        plus, minus, distance = full, 0, m
        for c in text:
            same = self.masks.get(c, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up = minus | ~(horizontal | plus)
            down = plus & horizontal
            if up & high:
                distance += 1
            elif down & high:
                distance -= 1
            up = (up << 1 | anchored) & full
            down = (down << 1) & full
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical
            yield distance


class Items:
    """A block of test items, ready to be looked up in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        self.ids, self.short, self.patterns, self.budgets, self.grams = [], [], [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            own = normal(text)
            if not own:
                continue
            budget = int(rate * len(own)) if len(own) >= least else 0
            cuts = [len(own) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(own[a:b].decode("latin-1"), []).append((len(self.ids), a))
            self.ids.append(key)
            self.short.append(len(own) < least)
            self.patterns.append(Pattern(own))
            self.grams.append([own[i : i + _GRAM] for i in range(len(own) - _GRAM + 1)])
            self.budgets.append(budget)
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (item, distance, start, end) of the best match of each item found."""
        data, starts = flat(texts)
        padded, at, _ = normalised(data, starts)
        out: list[list] = [[] for _ in range(len(starts) - 1)]
        if self.empty or not len(padded):
            return out
        places: dict[tuple[int, int], set[int]] = {}
        exact: dict[tuple[int, int], int] = {}
        ends, found = [], []
        for end, value in self.automaton.iter(padded.tobytes().decode("latin-1")):
            ends.append(end)
            found.append(value)
        owner = np.searchsorted(at, np.array(ends, np.int64), "right") - 1
        for text, end, (size, where) in zip(owner.tolist(), ends, found):
            for item, offset in where:
                if self.short[item]:
                    self._exact(padded, exact, text, item, end + 1 - size, end + 1)
                    continue
                places.setdefault((text, item), set()).add(end + 1 - size - offset)
        for (text, item), begins in places.items():
            if best := self._verified(padded, int(at[text]) + 1, int(at[text + 1]), item, sorted(begins)):
                out[text].append(best)
        for (text, item), begin in exact.items():
            begin -= int(at[text]) + 1
            out[text].append((self.ids[item], 0, begin, begin + len(self.patterns[item].text)))
        return out

    @staticmethod
    def _exact(padded, exact, text: int, item: int, begin: int, end: int):
        """Remember the first place of a short item that no letter or digit goes on from."""
        whole = padded[begin - 1] in (0, 32) and (end == len(padded) or padded[end] in (0, 32))
        if whole and (text, item) not in exact:
            exact[text, item] = begin

    def _verified(self, padded, low: int, high: int, item: int, begins: list[int]):
        pattern, budget = self.patterns[item], self.budgets[item]
        size, best, until = len(pattern.text), None, -1
        grams = self.grams[item]
        for begin in begins:
            start, end = max(low, begin - budget), min(high, begin + size + budget)
            start = max(start, until - size - budget)  # places that overlap are read once
            if end <= until:
                continue
            until = end
            window = padded[start:end].tobytes()
            there = {window[i : i + _GRAM] for i in range(len(window) - _GRAM + 1)}
            if sum(map(there.__contains__, grams)) < len(grams) - _GRAM * budget:
                continue
            for i, distance in enumerate(pattern.distances(window)):
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, start + i + 1)
        if best is None:
            return None
        distance, end = best
        back = padded[max(low, end - size - budget) : end][::-1].tobytes()
        mirror = Pattern(pattern.text[::-1])
        length = next(
            (i + 1 for i, d in enumerate(mirror.distances(back, anchored=True)) if d == distance), len(back)
        )
        return self.ids[item], distance, end - length - low, end - low


def matches(
    df: DataFrame,
    items: DataFrame,
    rate: float = RATE,
    least: int = MIN_BYTES,
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with ``matches``: array of (item_id, distance, start, end), best one per item.

    Offsets count normalised bytes. Items (item_id, text) that are null or have no letter or
    digit match nothing, those of fewer than ``least`` normalised bytes only exactly, as whole
    words; a null text has no match. Items with equal texts each give a match.
    """
    struct = T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
    items = items.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = without(df, ["matches"])
    names = [f"_matches_{b}" for b in range(blocks)]
    for b, name in enumerate(names):
        own = [(r["item_id"], r["text"]) for r in items.where(block == b).orderBy("item_id").collect()]
        shared = df.sparkSession.sparkContext.broadcast(own)
        out = append_columns(out, text, [T.StructField(name, T.ArrayType(struct))], _finder(shared, rate, least, struct))
    return out.withColumn("matches", F.concat(*[quoted(n) for n in names])).drop(*names)


def _finder(shared, rate: float, least: int, struct: T.StructType):
    held: list[Items] = []
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    )

    def compute(texts):
        if not held:
            held.append(Items(shared.value, rate, least))
        rows = [[dict(zip(struct.names, m)) for m in found] for found in held[0].find(texts)]
        return [pa.array(rows, kind)]

    return compute
