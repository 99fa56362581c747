import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agriclime.llm import packing
from agriclime.sources.tables import materialize

CONTENT = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_str(CONTENT)
    made.no_truncation()
    made.no_padding()
    return made


TEXTS = [
    None, "", " ", "\n\n", "a", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "It's we'll 'tis  \n  end  ",
    "été ÀÉ 日本語 \U0001f600\U0001f600 ﬁ", "\x00\x01 ​ ", "word " * 1030, "a" * 5000, " " * 3000, "12 345 " * 700,
    "-" * 4000, "same text", "same text",
]


def test_ids_and_cuts_equal_the_library(spark, documents, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "repeated id"), (3, "repeated id")]
    found = packing.pieces(documents(rows), CONTENT, capacity=64, keep_ids=True)
    got = defaultdict(list)
    for r in found.collect():
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        got[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    wanted = defaultdict(list)
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at, n = 0, 0
        while at < len(ids):
            size = (len(ids) - at) % 64 or 64
            wanted[key].append((n, at, ids[at : at + size].tobytes()))
            at, n = at + size, n + 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_slices_encode_as_the_whole(library):
    encoder = packing.Encoder(CONTENT, packing.ranks_suffice(CONTENT))
    assert encoder.fast is not None
    text = "It's  a\n\n test, of 12 slices é日 \t x" * 40 + " " * 50 + "z" * 300
    whole = library.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 100):
        parts = list(packing.slices(text, size))
        assert "".join(parts) == text and len(parts) > 5
        assert [i for p in parts for i in encoder.fast.encode(p, allowed_special="all")] == whole
    slow = packing.Encoder(CONTENT, False)
    assert slow.encode(text).tolist() == whole == encoder.encode(text).tolist()


def test_a_very_long_text(spark, documents):
    """50 MB with words, and 3 MB without a single blank: all tokens, in full pieces."""
    rows = [(1, "lorem ipsum dolor " * 2_800_000), (2, "xyz" * 1_000_000)]
    found = packing.pieces(documents(rows), CONTENT)
    got = {r[0]: r[1:] for r in found.groupBy("doc_id").agg(F.sum("length"), F.count("*"), F.min("length")).collect()}
    encoder = packing.Encoder(CONTENT, True)
    for key, text in rows:
        n = len(encoder.encode(text)) + 1
        assert got[key] == (n, -(-n // 1024), n % 1024 or 1024)


def best_fit(lengths, capacity):
    """Sequences of best fit, longest first, one piece at a time."""
    room, n = [0] * (capacity + 1), 0
    for s in sorted(lengths, reverse=True):
        for _ in range(lengths[s]):
            free = next((f for f in range(s, capacity + 1) if room[f]), None)
            if free is None:
                n, free = n + 1, capacity
            else:
                room[free] -= 1
            room[free - s] += 1
    return n


def check(lengths, made, capacity):
    ranks, full = defaultdict(list), defaultdict(list)
    for length, rank, count, sequence, each, offset in made.arrays().tolist():
        ranks[length].append((rank, count))
        for i in range(count):
            full[sequence + i // each].append((offset + i % each * length, length))
    for s, c in lengths.items():
        at = 0
        for rank, count in sorted(ranks[s]):
            assert rank == at
            at += count
        assert at == c
    assert set(full) == set(range(made.sequences))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 64, 200]))
    low = int(rng.choice([1, capacity // 5, capacity // 3]))
    sizes = rng.integers(low, capacity + 1, 1500)
    sizes[: int(rng.integers(0, 700))] = capacity // 2 + 1
    lengths = {int(s): int(c) for s, c in zip(*np.unique(sizes, return_counts=True))}
    for groups, large in packing.GROUPINGS:
        check(lengths, packing.plan(lengths, capacity, groups, large), capacity)
    made = packing.best_plan(lengths, capacity)
    assert made.sequences <= best_fit(lengths, capacity)
    assert made.sequences >= -(-sum(s * c for s, c in lengths.items()) // capacity)


def test_few_sizes_are_packed_better_than_by_best_fit():
    """Thirds and their neighbours: best fit pairs the longest, fillings are mixed."""
    lengths = {400: 1000, 342: 1000, 341: 1000, 280: 1000}
    made = packing.best_plan(lengths)
    check(lengths, made, 1024)
    area = -(-sum(s * c for s, c in lengths.items()) // 1024)
    assert made.sequences <= 1.01 * area < best_fit(lengths, 1024) * 0.95


def test_plan_does_not_grow_with_the_number_of_pieces():
    lengths = {s: 10**9 + s for s in range(1, 1025)}
    made = packing.best_plan(lengths)
    assert len(made.runs) < 5000
    assert made.sequences <= 1.002 * sum(s * c for s, c in lengths.items()) / 1024


def test_packed_table(spark, documents):
    """One length for a third of all, repeated rows, extra and clashing columns; whole sequences."""
    rows = [(i, "alpha beta " * (i % 90)) for i in range(400)] + [(7, "hot text")] * 200 + [(None, None)] * 3
    found = materialize(packing.pieces(documents(rows), CONTENT, capacity=128, keep_ids=True))
    packed = packing.pack(found.withColumn("offset", F.lit("old")).withColumn("extra", F.lit(1)), 128)
    assert packed.columns == [*found.columns, "extra", "sequence_id", "offset"]
    packed = materialize(packed)
    assert packed.count() == found.count()
    places = defaultdict(list)
    for r in packed.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    for sequence in places.values():
        at = 0
        for offset, length, _ in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 128
    lengths = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    assert len(places) <= best_fit(lengths, 128)
    made = {r["sequence_id"]: (r["n_tokens"], r["ids"]) for r in packing.sequences(packed).collect()}
    assert made == {k: (sum(p[1] for p in v), b"".join(p[2] for p in sorted(v))) for k, v in places.items()}
    again = packing.pack(found.repartition(5), 128)
    key = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(str, again.select(key).collect())) == sorted(map(str, packed.select(key).collect()))


def test_empty_table(spark, documents):
    assert packing.pack(packing.pieces(documents([]), CONTENT)).collect() == []
