import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agriclime.llm import buckets, minhash
from agriclime.llm.components import components


def union_find(links, nodes=()):
    root = {x: x for x in nodes}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    sets = [(i, s) for i, s in sets if s]
    links = [
        (i, j)
        for k, (i, s) in enumerate(sets)
        for j, t in sets[:k]
        if 100 * len(s & t) >= 75 * len(s | t)
    ]
    return union_find(links, [i for i, _ in rows if i is not None])


@pytest.mark.parametrize("shape", ["chain", "star", "random", "copies"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(1000, i) for i in range(300)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)],
        "copies": [(1, 2), (2, 1), (3, 3), (1, 2)],
    }[shape]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {x: c for x, c in union_find([e for e in links if e[0] != e[1]]).items()}
    assert {r["node"]: r["component"] for r in found} == expected


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("limit", [float("inf"), 3.0])
def test_buckets_lose_no_component(spark, limit):
    """Points on a line, linked if 3 apart at most: pivots alone would miss most links."""
    rng = random.Random(5)
    points = [(n, rng.randrange(400)) for n in range(250)]
    members = [(rng.randrange(3), n, x) for n, x in points for _ in range(2)]
    members = list({(b, n): (b, n, x) for b, n, x in members}.values())
    place = dict(points)
    compared = []

    def confirm(pairs):
        rows = [(r["a"], r["b"]) for r in pairs.collect()]
        compared.extend(rows)
        out = [(a, b, abs(place[a] - place[b]) <= 3, float(abs(place[a] - place[b]))) for a, b in rows]
        return spark.createDataFrame(out, "a long, b long, alike boolean, apart double")

    df = spark.createDataFrame(members, "bucket long, node long, info long")
    found = buckets.linked(df, confirm, limit=limit)
    homes = {}
    for b, n, _ in members:
        homes.setdefault(b, []).append(n)
    links = [(a, b) for m in homes.values() for a in m for b in m if a < b and abs(place[a] - place[b]) <= 3]
    assert {r["node"]: r["component"] for r in found.collect()} == union_find(links)
    assert len(compared) == len(set(compared))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**64, 200, dtype=np.uint64)])
    sets = [np.unique(base), np.unique(other), base[:1], base[:3], base[:0]]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketch = minhash.sketches(np.concatenate(sets), starts)
    assert (sketch[:4] != minhash._EMPTY).all() and (sketch[4] == minhash._EMPTY).all()
    assert abs((sketch[0] == sketch[1]).mean() - 800 / 1200) < 0.15


def texts():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b c d"), (906, "A  b\tC d")]
    rows += [(907, "é x y"), (908, "É x y"), (None, "one"), (0, rows[0][1]), (909, "long " * 30_000)]
    return rows


def test_equals_brute_force(documents):
    rows = texts()
    found = minhash.near_duplicates(documents(rows).withColumn("kept", F.lit("mine"))).collect()
    expected = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes


def test_prefixes_lose_no_link(documents):
    """One base text changed ever more: most pairs share bands, only some are links."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(i // 6):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    expected = brute(rows)
    assert 1 < len(set(expected.values())) < 50
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(rows)).collect()} == expected


def test_parity_marks_bound_the_difference():
    rng = np.random.default_rng(2)
    for size, own in [(1, 0), (150, 3), (150, 60), (3000, 200)]:
        both, left, right = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (size, own, own // 2))
        sets = [np.unique(np.concatenate([both, x])) for x in (left, right)]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        marks = minhash.parity_marks(np.concatenate(sets), starts)
        bits = int(np.bitwise_count(marks[0] ^ marks[1]).sum())
        assert bits <= own + own // 2
        assert bits >= 0.7 * (own + own // 2)


def test_texts_just_too_far_are_not_all_compared(documents, monkeypatch):
    """A large group of copies and many texts that are each just too far from all of them."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        own = list(base)
        places = [rng.randrange(150)] if i < 160 else range(10 + i % 10, 150, 25)
        for at in places:
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    compared, real = [], minhash.linked

    def counted(members, confirm, *rest):
        def counting(pairs):
            compared.append(pairs.count())
            return confirm(pairs)

        return real(members, counting, *rest)

    monkeypatch.setattr(minhash, "linked", counted)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(rows)).collect()}
    assert found == {i: 0 if i < 160 else i for i, _ in rows}
    assert sum(compared[1:]) < 500, compared


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []


def test_shingle_sets_equal_definition():
    rows = [t for _, t in texts()]
    joined, starts, sequence = minhash.shingle_sets(pa.array(rows, pa.string()))
    assert np.diff(starts).tolist() == [len(shingles(t)) for t in rows]
    same = {}
    for t, s in zip(rows, sequence):
        words = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        same.setdefault(int(s), set()).add(words)
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("swapped", [False, True])
def test_texts_of_a_repeated_id_are_all_compared(documents, swapped):
    """Two texts under one id: both keep their links, whichever comes first."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail")]
    if swapped:
        rows[:2] = rows[1::-1]
    for parts in (1, 3):
        found = minhash.near_duplicates(documents(rows).repartition(parts)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1)]
