"""License scans: MinHash bands of text windows retrieve templates, containment verifies them.

Templates are known license notices (fixed values below, or the caller's). Words are runs of
ASCII letters, digits and multi-byte characters, in lower case. A template of ``n`` words has
``n - WORDS + 1`` shingles (all its words where there are fewer) and is looked for in windows
of ``n`` words at every place of the text. A window that holds the share ``CONTAINED`` of the
template's shingles has a similarity of at least ``CONTAINED / (2 - CONTAINED)`` with it, as
both have as many shingles at most; ``BANDS`` bands of ``ROWS`` minimum hashes find such a
window with a probability over 1 - 1e-6 (``chance``), an exact one always. Verified is the
window's containment: the share of the template's distinct shingles in it.

Windows overlap in all but one word, so their minima come from sliding minima over the
shingles, one pass per template length and hash function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from agriclime.llm.common import append_columns, flat
from agriclime.llm.hashing import LOWER, mix, prefix, seeds, span_hash, words

# Wording of public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is"
        " distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
}

WORDS = 3
CONTAINED = 0.8
BANDS, ROWS = 14, 1
_PLACES = seeds(WORDS, 51) | np.uint64(1)
_HASHES = seeds(BANDS * ROWS, 52) | np.uint64(1)  # factors; shingles are mixed already
_CELL = seeds(ROWS, 53) | np.uint64(1)
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def chance(similarity: float) -> float:
    """Probability that sets of this similarity share a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def _words(texts: pa.Array):
    data, starts = flat(texts)
    data = LOWER[data]
    begin, end, first = words(data, starts, _BLANK)
    return span_hash(prefix(data), begin, end), begin, end, first, data, starts


def _shingles(word: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        out += word[k : k + len(out)] * _PLACES[k]
    return mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Templates:
    def __init__(self, notices: dict[str, str]):
        self.by_length: dict[tuple[int, int], list[tuple[str, np.ndarray, np.ndarray]]] = {}
        for name in sorted(notices):
            word = _words(pa.array([notices[name]]))[0]
            if not len(word):
                continue
            size = min(WORDS, len(word))
            own = _shingles(word, size)
            minima = [(own * s).min() for s in _HASHES]
            self.by_length.setdefault((len(word), size), []).append((name, np.unique(own), self._bands(minima)))

    @staticmethod
    def _bands(minima) -> np.ndarray:
        """A key for each band (first axis) of single values or of arrays over windows."""
        rows = np.asarray(minima).reshape(BANDS, ROWS, -1)
        return mix((rows * _CELL[None, :, None]).sum(1, dtype=np.uint64))

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        """Per text: the templates found, each at its best window (first of equals)."""
        word, begin, end, first, data, starts = _words(texts)
        out: list[list[dict]] = [[] for _ in range(len(starts) - 1)]
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for (length, size), group in self.by_length.items():
            if len(word) < length:
                continue
            shingles = _shingles(word, size)
            width = length - size + 1
            owner = np.searchsorted(first, np.arange(len(word) - length + 1), "right") - 1
            inside = np.arange(len(owner)) + length <= first[owner + 1]
            hit = np.zeros((len(group), len(owner)), bool)
            for band in range(BANDS):
                rows = [_sliding_min(shingles * s, width) for s in _HASHES[band * ROWS : (band + 1) * ROWS]]
                key = mix(sum(r * c for r, c in zip(rows, _CELL)))
                for t, (_, _, keys) in enumerate(group):
                    hit[t] |= key == keys[band, 0]
            for t, (name, own, _) in enumerate(group):
                best: dict[int, tuple[float, int]] = {}
                for at in np.flatnonzero(hit[t] & inside).tolist():
                    there = np.unique(shingles[at : at + width])
                    share = len(np.intersect1d(own, there, assume_unique=True)) / len(own)
                    text = int(owner[at])
                    if share >= CONTAINED and share > best.get(text, (0.0, 0))[0]:
                        best[text] = (share, at)
                for text, (share, at) in best.items():
                    base = characters[starts[text]]
                    out[text].append(
                        {
                            "license": name,
                            "containment": share,
                            "start": int(characters[begin[at]] - base),
                            "end": int(characters[end[at + length - 1]] - base),
                        }
                    )
        for found in out:
            found.sort(key=lambda m: m["license"])
        return out


def scan(df: DataFrame, notices: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``licenses``: array of (license, containment, start, end), by name.

    Offsets count characters. A null or empty text, and one shorter than every template, has
    none; templates without words are never found; equal templates are each reported.
    """
    found = T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("containment", T.DoubleType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    )
    shared = df.sparkSession.sparkContext.broadcast(NOTICES if notices is None else notices)
    held: list[Templates] = []

    def compute(texts):
        if not held:
            held.append(Templates(shared.value))
        return [pa.array(held[0].scan(texts), kind)]

    return append_columns(df, text, [T.StructField("licenses", T.ArrayType(found))], compute)
