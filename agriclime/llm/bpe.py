"""Byte-level BPE, speculative: guess the tokens, check all neighbours, merge only failures.

A word's guess is its greedy longest match. An encoding is the one that merging gives if
and only if merging would keep every two neighbouring tokens apart, so all pairs of all
new words are checked at once: for a pair, the tokens' histories along the common border
are walked back in time, and the pair fails if a merge across the border came first.
Words with a failing pair (or a token that merging never makes) are merged exactly.

The vocabulary file's content is read on the driver (its size is fixed) and broadcast.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from agriclime.llm.common import append_columns

# Fixed value: the word pattern of the vocabulary.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 200_000
_SHORT = 48
_NEVER = np.iinfo(np.int64).max


def _byte_of_character() -> dict[str, int]:
    """Vocabulary files write visible Latin-1 characters as themselves, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    pieces: list[bytes]  # by id
    ids: dict[bytes, int]
    special: dict[str, int]
    born: np.ndarray  # rank of the merge that makes a token, -1 for single bytes
    left: np.ndarray  # its parts
    right: np.ndarray
    pair_keys: np.ndarray  # left << 32 | right of every merge, sorted, and its rank
    pair_ranks: np.ndarray
    merges: dict[tuple[int, int], tuple[int, int]]  # (left, right): (rank, result)
    longest: int
    single: list[int]  # id of every byte
    _reachable: np.ndarray | None = None

    @staticmethod
    def read(content: str) -> Vocabulary:
        file, byte = json.loads(content), _byte_of_character()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        names = {i: s for s, i in file["model"]["vocab"].items()} | {i: s for s, i in special.items()}
        pieces = [
            names[i].encode() if names[i] in special else bytes(byte[c] for c in names[i])
            for i in range(len(names))
        ]
        ids = {p: i for i, p in enumerate(pieces) if names[i] not in special}
        born = np.full(len(pieces), -1, np.int64)
        left, right = np.arange(len(pieces)), np.arange(len(pieces))
        merges = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = (file["model"]["vocab"][s] for s in (a, b))
            made = file["model"]["vocab"][a + b]
            merges[x, y] = (rank, made)
            born[made], left[made], right[made] = rank, x, y
        keys = np.array([(x << 32) | y for x, y in merges] or [0], np.int64)
        ranks = np.array([r for r, _ in merges.values()] or [_NEVER], np.int64)
        order = np.argsort(keys)
        return Vocabulary(
            pieces, ids, special, born, left, right, keys[order], ranks[order], merges,
            max(map(len, ids)), [ids[bytes([b])] for b in range(256)],
        )

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match; every byte is a token, so it always ends."""
        out, i, ids = [], 0, self.ids
        while i < len(word):
            j = min(len(word), i + self.longest)
            while (found := ids.get(word[i:j])) is None:
                j -= 1
            out.append(found)
            i = j
        return out

    def _border(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of ``a`` and ``b`` comes before rank ``until``."""
        ok = np.ones(len(a), bool)
        x, y, x_until, y_until = a.copy(), b.copy(), until.copy(), until.copy()
        at = np.arange(len(a))
        while len(at):
            key = (x[at] << 32) | y[at]
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], _NEVER)
            # Of two equal merges the left one comes first.
            early = (rank < x_until[at]) & (rank <= y_until[at]) & (rank < until[at])
            ok[at[early]] = False
            at = at[~early & ((self.born[x[at]] >= 0) | (self.born[y[at]] >= 0))]
            later = self.born[x[at]] >= self.born[y[at]]
            p, q = at[later], at[~later]
            x_until[p], x[p] = self.born[x[p]], self.right[x[p]]
            y_until[q], y[q] = self.born[y[q]], self.left[y[q]]
        return ok

    def kept_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves tokens ``a``, ``b`` as they are when they meet."""
        return self._border(a, b, np.full(len(a), _NEVER))

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: the earliest merge first, the leftmost of equals."""
        return self._merge_short(word) if len(word) <= _SHORT else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        token, find, none = [self.single[b] for b in word], self.merges.get, (_NEVER, 0)
        found = [find(pair, none) for pair in zip(token, token[1:])]
        while found and (first := min(found))[0] < _NEVER:
            i = found.index(first)
            token[i : i + 2] = [first[1]]
            del found[i]
            if i:
                found[i - 1] = find((token[i - 1], token[i]), none)
            if i < len(found):
                found[i] = find((token[i], token[i + 1]), none)
        return token

    def _merge_long(self, word: bytes) -> list[int]:
        token = [self.single[b] for b in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(token):
                if found := self.merges.get((token[i], token[after[i]])):
                    heapq.heappush(heap, (found[0], i, token[i], token[after[i]]))

        for i in range(len(token)):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if token[i] != x or j >= len(token) or token[j] != y:
                continue
            token[i], token[j] = self.merges[x, y][1], -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [t for t in token if t >= 0]

    def encode(self, words: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each distinct word."""
        raw = [w.encode() for w in words]
        guesses = [self.guess(w) for w in raw]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        tokens = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        keys, where = np.unique((tokens[:-1] << 32) | tokens[1:], return_inverse=True)
        apart = self.kept_apart(keys >> 32, keys & 0xFFFFFFFF)[where]
        failed = np.zeros(len(words), bool)
        failed[owner[:-1][~apart & (owner[:-1] == owner[1:])]] = True
        failed[owner[~self.reachable()[tokens]]] = True
        for i in np.flatnonzero(failed):
            guesses[i] = self.merge(raw[i])
        return [np.array(g, "<u4").tobytes() for g in guesses]

    def reachable(self) -> np.ndarray:
        """Tokens that merging makes of their own bytes: their parts are, and meet undisturbed."""
        if self._reachable is None:
            good = self.born < 0
            merged = np.flatnonzero(self.born >= 0)
            undisturbed = np.ones(len(good), bool)
            undisturbed[merged] = self._border(self.left[merged], self.right[merged], self.born[merged])
            for t in merged[np.argsort(self.born[merged])]:
                good[t] = undisturbed[t] and good[self.left[t]] and good[self.right[t]]
            self._reachable = good
        return self._reachable

    def decode(self, packed: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


class Encoder:
    """Encodes texts; remembers the words it has seen, up to a fixed number.

    When half of that number is new, the words that were not met since the half before go.
    """

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.vocabulary, self.cache_words = vocabulary, cache_words
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words = regex.compile(WORDS).findall
        marks = "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))
        self.split = regex.compile(f"({marks})").split if marks else lambda text: [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.special.items()}
        runs = [
            [w for part in self.split(t) for w in ([part] if part in special else self.words(part))]
            for t in texts
        ]
        if len(self.cache) > self.cache_words // 2:
            self.before, self.cache = self.cache, {}
        cache, before = self.cache, self.before
        met = {w for run in runs for w in run if w not in cache and w not in special}
        cache.update((w, before[w]) for w in met if w in before)
        new = [w for w in met if w not in cache]
        if new:
            cache.update(zip(new, self.vocabulary.encode(new)))
        cache.update(special)
        return [b"".join([cache[w] for w in run]) for run in runs]


def vocabulary_content(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_decode(df: DataFrame, content: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` (packed little-endian 32-bit) and ``decoded``.

    ``content`` is the vocabulary file. Special tokens in a text become their own ids, as
    the tokenizers library does by default. A null text is encoded as an empty one.
    """
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]
    shared = df.sparkSession.sparkContext.broadcast(content)
    held: list[Encoder] = []

    def compute(texts):
        if not held:
            held.append(Encoder(Vocabulary.read(shared.value)))
        packed = held[0].encode([t or "" for t in texts.to_pylist()])
        decode = held[0].vocabulary.decode
        return [
            pa.array([len(p) // 4 for p in packed], pa.int64()),
            pa.array(packed, pa.binary()),
            pa.array([decode(p) for p in packed], pa.string()),
        ]

    return append_columns(df, text, fields, compute)
