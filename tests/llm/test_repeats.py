import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agriclime.llm import repeats
from agriclime.llm.suffixes import suffix_arrays
from agriclime.sources.tables import application_folder


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6))
def test_suffix_arrays(texts):
    symbols = np.array([x for t in texts for x in [*t, 0]])
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    found = suffix_arrays(symbols, offsets)
    for a, b in zip(offsets, offsets[1:]):
        assert found[a:b].tolist() == sorted(range(a, b), key=lambda i: symbols[i:b].tolist())


def brute(rows):
    length, first = repeats.LENGTH, {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - length + 1 if i is not None else 0):
            piece = raw[k : k + length]
            first[piece] = min(first.get(piece, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1 if i is not None else 0):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        out.append((i, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def corpus():
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [make(rng.randint(45, 160)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [make(rng.randint(0, 60)) + rng.choice([*passages, ""]) for _ in range(rng.randint(0, 4))]
        text = "".join(parts)
        if rng.random() < 0.3 and len(text) > 20:  # a near copy
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((rng.choice([i, 2 * i + 100]) * 3, text))
    rows = list(dict(rows).items())
    rows += [(5001, rows[3][1]), (5002, rows[3][1]), (5003, None), (5004, ""), (5005, "ab" * 400), (5006, "ab" * 300 + "c" * 60)]
    return rows + [(5007, "x" * 49), (5008, "x" * 49), (5009, "x" * 50), (5010, "x" * 50), (None, rows[3][1])]


@pytest.mark.parametrize("variants", [repeats.VARIANTS, 1])
def test_equals_brute_force(documents, monkeypatch, variants):
    monkeypatch.setattr(repeats, "VARIANTS", variants)
    rows = corpus()
    df = documents(rows).withColumns({"n_bytes": F.lit("mine"), "h": F.lit(1), "cuts": F.lit(2)})
    found = repeats.remove_repeats(df).collect()
    key = lambda r: (r[0] is None, r)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found), key=key)
    assert got == sorted(brute(rows), key=key)


def test_repeated_rows(documents):
    text, other = "a passage that is longer than fifty bytes in all, surely", "another text of more than fifty bytes that nobody else has"
    rows = [(4, text), (4, text), (2, other), (2, other), (9, text + other)]
    found = sorted((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(documents(rows)).collect())
    assert found == [(2, 0), (2, 0), (4, 0), (4, 0), (9, len(text) + len(other))]


def test_one_id_with_two_texts_does_not_fail(documents):
    rows = [(1, "x" * 80), (1, "y" * 80), (2, "x" * 60), (3, "y" * 60)]
    found = repeats.remove_repeats(documents(rows)).collect()
    assert sorted(r["n_removed"] for r in found) == [0, 0, 0, 60]


def test_empty_table(documents):
    assert repeats.remove_repeats(documents([])).collect() == []


def test_segments_cover_all_windows():
    rng = np.random.default_rng(0)
    sizes = [0, 49, 50, 51, 300, 5, 2000]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, text, first, count = repeats.segments(data, starts)
    windows = sorted((t, s) for t, f, n in zip(text, first - starts[text], count) for s in range(f, f + n))
    assert windows == [(t, s) for t, n in enumerate(sizes) for s in range(n - 49)]
    assert count.max() <= repeats.RUN


def test_only_what_the_result_reads_stays_stored(spark, documents):
    folder = application_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus()
    found = repeats.remove_repeats(documents(rows))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"cuts"}
    expected = sorted((str(i), n, gone) for i, n, gone, *_ in brute(rows))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in found.collect()) == expected


def test_hot_anchors_are_cut_by_longer_pieces(spark, documents, monkeypatch):
    monkeypatch.setattr(repeats, "VARIANTS", 4)
    made, store = [], repeats.store
    monkeypatch.setattr(repeats, "store", lambda df, label: made.append((label, store(df, label))) or made[-1][1])
    monkeypatch.setattr(repeats, "discard", lambda *tables: None)
    rng = random.Random(11)
    line = "a line of boilerplate that stands in most of the texts, between other words"

    def own(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))

    rows = [(i, f"{own(60)}{line[rng.randrange(20):]}{rng.choice('xyz')}{rng.choice('xyz')}{own(60)}") for i in range(40)]
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    found = sorted(tuple(r[c] for c in columns) for r in repeats.remove_repeats(documents(rows)).collect())
    assert found == brute(rows) and any(r[2] for r in found)
    tables = {}
    for label, df in made:
        tables.setdefault(label, []).append(df)
    assert len(tables["finer"]) == 2
    windows = sum(len(x.encode()) - repeats.LENGTH + 1 for _, x in rows)
    assert sum(df.count() for df in tables["finer"]) < windows / 2
    assert all(df.where("hash is null or octet_length(segment) < 50").count() == 0 for df in tables["finer"])


def test_cuts_in_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(repeats, "_TEXT", 150)
    rng = random.Random(12)
    rows = []
    for i in range(60):
        text = None if i % 9 == 0 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 200)))
        raw = (text or "").encode()
        ends = sorted(rng.sample(range(len(raw) + 1), 2)) if len(raw) > 60 else None
        cuts = [{"lo": ends[0], "hi": ends[1]}, {"lo": 0, "hi": 7}, {"lo": 7, "hi": 9}] if ends and i % 3 else None
        rows.append({"doc_id": i, "text": text, "copy": [None, False, True][i % 3 if i % 5 == 0 else 1], "cuts": cuts})
    cut = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("copy", pa.bool_()), ("cuts", cut)])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    parts = list(repeats._cleaned([batch.slice(7, 50)]))
    assert len(parts) > 5
    for got, r in zip(pa.Table.from_batches(parts).to_pylist(), rows[7:57]):
        raw = (r["text"] or "").encode()
        gone = bytearray(len(raw))
        for c in r["cuts"] or ():
            gone[c["lo"] : c["hi"]] = b"\1" * (c["hi"] - c["lo"])
        if r["copy"] and len(raw) >= repeats.LENGTH:
            gone = bytearray(b"\1" * len(raw))
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        assert got == {"doc_id": r["doc_id"], "n_bytes": len(raw), "n_removed": sum(gone), "n_spans": spans, "kept": kept}


def test_phrases_shorter_than_a_window_are_not_cut_out(documents, monkeypatch):
    made, store = {}, repeats.store
    monkeypatch.setattr(repeats, "store", lambda df, label: made.setdefault(label, store(df, label)))
    monkeypatch.setattr(repeats, "discard", lambda *tables: None)
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase, passage = "a phrase of 29 bytes is here.", own(90)
    rows = [(i, f"{own(70)}{phrase}{own(70)}") for i in range(30)]
    rows += [(100 + i, f"{own(40)}{passage}{own(40)}") for i in range(2)]
    found = sorted(tuple(r) for r in repeats.remove_repeats(documents(rows)).collect())
    assert [(*r[:4], bytes(r[4])) for r in found] == brute(rows)
    docs = {r["doc"] for r in made["pieces"].collect()}
    assert {100, 101} <= docs and len(docs) < 8  # the phrase alone brings all 30


def test_rows_kept_by_their_sides_hold_all_shared_windows(monkeypatch):
    rng = random.Random(13)
    for alphabet in ("ab", "abcdefgh", "x", "abcdefghijklmnop "):
        passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(40, 130))) for _ in range(4)]
        make = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + rng.choice([*passages, "", "ab" * 200])  # noqa: E731, B023
        texts = ["".join(make() for _ in range(rng.randint(1, 4))) for _ in range(25)]
        where = {}
        for doc, text in enumerate(texts):
            for start in range(len(text) - repeats.LENGTH + 1):
                where.setdefault(text[start : start + repeats.LENGTH], set()).add((doc, start))
        shared = {w for places in where.values() if len({d for d, _ in places}) > 1 for w in places}
        batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array(texts)], ["doc_id", "text"])
        for held in (repeats.HELD_ROWS, 10):  # beyond it, anchors alone
            monkeypatch.setattr(repeats, "HELD_ROWS", held)
            found = [r for b in repeats._repeated(repeats._blocks(1)([batch])) for r in b.to_pylist()]
            assert shared <= {(r["doc"], s) for r in found for s in range(r["start"], r["start"] + r["count"])}
            monkeypatch.undo()
