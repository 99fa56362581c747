import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_lines import distance

from agriclime.llm import decontaminate as dc

LETTERS = st.text(alphabet="abc", min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(LETTERS, st.text(alphabet="abc", max_size=20))
def test_myers_equals_definition(pattern, text):
    p, t = pattern.encode(), text.encode()
    best = [min(distance(p, t[i : j + 1]) for i in range(j + 2)) for j in range(len(t))]
    assert list(dc.Pattern(p).distances(t)) == best
    assert list(dc.Pattern(p).distances(t, anchored=True)) == [distance(p, t[: j + 1]) for j in range(len(t))]


def test_normal_form():
    assert [dc.normal(x) for x in ("", " A,b!! ", "\n\n", "É x--Y")] == [b"", b"a b", b"", "É x y".encode()]


def least_distance(item, text):
    return distance(item, text, free=True)


def corpus():
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    items = [(i, make(rng.randint(30, 90))) for i in range(12)] + [(50, "short"), (51, None), (52, ""), (None, make(60))]
    docs = []
    for i in range(80):
        parts = [make(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items[:12])[1]
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(passage))
                passage = passage[:at] + rng.choice(["", "z", "zz"]) + passage[at + 1 :]
            parts += [passage.upper().replace(" ", ", "), make(rng.randint(0, 40))]
        docs.append((i, " ".join(parts)))
    docs += [(92, "A Short!"), (93, "shortly, ashort"), (94, "ends in short"), (95, "shorts short-ish short")]
    return items, [*docs, (90, None), (91, ""), (None, items[0][1]), (0, docs[0][1])]


def test_equals_brute_force(spark, documents):
    items, docs = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    df = documents(docs).withColumns({"Matches": F.lit("mine"), "item_id": F.lit(1)})
    expected = []
    for doc, text in docs:
        own = dc.normal(text or "")
        for item, passage in items:
            pattern = dc.normal(passage or "")
            if item is None or not pattern:
                continue
            if len(pattern) < dc.MIN_BYTES:
                if b" " + pattern + b" " in b" " + own + b" ":
                    expected.append((str(doc), item, 0))
                continue
            least = least_distance(pattern, own)
            if least <= int(dc.RATE * len(pattern)):
                expected.append((str(doc), item, least))
    assert 10 < len(expected)
    for block in (dc.BLOCK_BYTES, 200):
        out = dc.matches(df, table, block_bytes=block).collect()
        assert len(out) == len(docs)
        got = [(str(r["doc_id"]), m["item_id"], m["distance"]) for r in out for m in r["matches"]]
        assert sorted(got) == sorted(expected)
        for r in out:
            for m in r["matches"]:
                own = dc.normal(r["text"])[m["start"] : m["end"]]
                pattern = dc.normal(dict(items)[m["item_id"]])
                assert distance(pattern, own) == m["distance"]


def test_short_items_match_whole_words(spark, documents):
    items = spark.createDataFrame([(1, "Cat, dog"), (2, "x"), (3, " !? ")], "item_id long, text string")
    docs = documents([(1, "a cat  dog."), (2, "cat dogs"), (3, "bobcat dog"), (4, "X"), (5, "xx x"), (6, "!?"), (7, None)])
    out = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in dc.matches(docs, items).collect()}
    assert out == {1: [(1, 0, 2, 9)], 2: [], 3: [], 4: [(2, 0, 0, 1)], 5: [(2, 0, 3, 4)], 6: [], 7: []}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["matches"] for r in dc.matches(documents([(1, "text")]), none).collect()] == [[]]
    one = spark.createDataFrame([(1, "a passage of more than thirty-two letters")], "item_id long, text string")
    assert dc.matches(documents([]), one).collect() == []
    assert dc.Items([], 0.1, 1).find(pa.array(["x"])) == [[]]
