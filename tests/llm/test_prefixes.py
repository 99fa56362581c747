import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.llm import prefixes

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("depth", T.LongType()),
    ]
)


def brute_force(rows):
    """Nodes by their whole sequences of turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:3], _digest(*t[2:])))] for c, ts in own.items()}
    members = defaultdict(list)
    full = {}
    for c in own:
        base, h = c - (c % 5 if c >= 0 else -(-c % 5)), zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:] if base != c else own[c])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    below = defaultdict(lambda: [0, 0])
    for node in members:
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += node not in children
            below[node[:d]][1] += saved
    out = set()
    for node, convs in members.items():
        ends = sorted(c for c in convs if full[c] == node)
        out.add(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                len(children.get(node, ())), *below[node],
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return out


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS).repartition(3)
    result = prefixes.prefix_trie(table, **options)
    assert result.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    assert {t for _, t in result.dtypes} == {"bigint", "string"}
    listed = [tuple(r) for r in result.collect()]
    assert len(set(listed)) == len(listed)
    return set(listed)


def cases(seed):
    """Few texts, so that prefixes meet; nulls, gaps, ties, repeated rows, odd ids."""
    draw = random.Random(seed)
    ids = [*range(40), -3, -5, -11, 2**62 + 1, *range(200, 260, 5)]
    rows = []
    for c in ids:
        if draw.random() < 0.15:
            continue
        for t in range(draw.choice([1, 2, 3, 5, 9, 14])):
            rows.append(
                (c, draw.choice([t, t, t, t, None, 2]), draw.choice(["user", "user", None, ""]), draw.choice(["", None, "a", "é" * 3, "ab", "ab"]))
            )
    return rows + [(None, 0, "user", "lost")] + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_brute_force(spark, seed):
    rows = cases(seed)
    assert found(spark, rows) == brute_force(rows)


def test_copies_of_one_long_conversation(spark, monkeypatch):
    """A conversation over several sort partitions and blocks, and many copies of a short one."""
    monkeypatch.setattr(prefixes, "BLOCK_TURNS", 7)
    monkeypatch.setattr(prefixes, "CHUNK_IDS", 3)
    rows = [(10, t, "user", f"t{t % 11}") for t in range(400)]
    rows += [(c, t, "user", f"same{t}") for c in range(100, 400, 5) for t in range(3)]
    rows += [(15, t, "user", f"t{t % 11}") for t in range(333)]
    rows += [(25, 0, "user", "w" * 3_000_000), (30, 0, "user", "w" * 3_000_000)]
    assert found(spark, rows) == brute_force(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert found(spark, []) == set()
    absent = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:6]
    rows = [(c, 0, "user", "only") for c in absent]
    expected = brute_force(rows)
    assert {r[:2] for r in expected} == {(absent[0], 0)}
    assert found(spark, rows) == expected


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    """With bases of 0 only a sequence's first turn counts: those nodes are not equal."""
    rows = cases(3)
    tried, real = [], prefixes.bases

    def weak(seed):
        tried.append(seed)
        return [0] * prefixes.LANES if seed == 0 else real(seed)

    inverse = pow
    monkeypatch.setattr(prefixes, "bases", weak)
    monkeypatch.setattr(prefixes, "pow", lambda b, e, p: 0 if b == 0 else inverse(b, e, p), raising=False)
    assert found(spark, rows) == brute_force(rows)
    assert tried == [0, 1]


def test_texts_are_not_moved_for_unshared_prefixes(spark):
    """Texts go through the first sort alone; rebuilt prefixes carry numbers."""
    rows = cases(4)
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS)
    base = prefixes.bases(0)
    turns = prefixes.stored_turns(table, base)
    plans = prefixes._plans(turns, 5, 8)
    made = prefixes._rows(turns, plans, base, 5, 8)
    assert "text" not in made.columns and "role" not in made.columns
    assert made.select(F.max("depth")).first()[0] >= 9
