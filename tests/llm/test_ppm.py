import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from agriclime.llm import ppm

TEXTS = [
    (1, "the cat and the hat", "en"), (2, "the dog that the man had", "en"), (3, "der hund und die katze", "de"),
    (4, "die frau und der mann über", "de"), (5, "", "en"), (6, None, "de"), (7, "x", None), (None, "hut", "de"),
]


def brute(texts, lang, text):
    """Code length of ``text`` by the definition, contexts of up to three bytes."""
    counts = defaultdict(Counter)
    for _, t, own in texts:
        if own == lang and t is not None:
            raw = b"\0\0\0" + t.encode()
            for i in range(3, len(raw)):
                for k in range(4):
                    counts[k, raw[i - k : i]][raw[i]] += 1

    def p(k, context):
        shorter = p(k - 1, context[1:]) if k else [1 / 256] * 256
        n = counts[k, context]
        if not n:
            return shorter
        total, q = sum(n.values()), len(n)
        rest = max(1 - sum(shorter[b] for b in n), 1e-12)
        return [n[b] / (total + q) if b in n else q / (total + q) / rest * shorter[b] for b in range(256)]

    raw = b"\0\0\0" + text.encode()
    return sum(-math.log2(p(3, raw[i - 3 : i])[raw[i]]) for i in range(3, len(raw)))


@pytest.fixture(scope="module")
def model(spark):
    return ppm.learn(spark.createDataFrame(TEXTS, "doc_id long, text string, lang string"))


def lengths(model, texts):
    return sum(ppm.code_lengths(s, pa.array(texts)) for s in model.shards())


@pytest.mark.parametrize("shard_bytes", [1, 400, 1 << 30])
def test_code_lengths_equal_the_definition(spark, shard_bytes):
    model = ppm.learn(spark.createDataFrame(TEXTS, "doc_id long, text string, lang string"), shard_bytes)
    assert (len(model.cuts) > 2) == (shard_bytes < 1 << 30)
    texts = ["the man", "der mann über", "qz#", "", "t", "the cat and the hat"]
    found = lengths(model, texts)
    for text, row in zip(texts, found):
        for lang, bits in zip(model.languages, row):
            assert bits == pytest.approx(brute(TEXTS, lang, text), rel=1e-4, abs=1e-4)


def test_every_context_is_kept(spark):
    """Also those of a rare language beside a large one, whatever the size of a shard."""
    from agriclime.llm import queries

    rows = queries.table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null and text is not null")
    rare = spark.createDataFrame([("zw\u00fclf xylophonk\u00e4fig qu\u00e4len", "rare")], "text string, lang string")
    model = ppm.learn(rows.select("text", "lang").unionByName(rare), 1 << 16)
    held = sum(len(s.orders[1].keys) for s in model.shards())
    counted = model.counts.where("order = 3").select("context", "byte").distinct().count()
    assert held == counted and len(model.cuts) > 3
    own = [(None, "zw\u00fclf xylophonk\u00e4fig qu\u00e4len", "rare")]
    found = lengths(model, ["xylophonk\u00e4fig"])[0, model.languages.index("rare")]
    assert found == pytest.approx(brute(own, "rare", "xylophonk\u00e4fig"), rel=1e-4)


def test_passes_agree(spark, documents, monkeypatch):
    """Many shards, many passes: the same result as one."""
    from pyspark.sql import functions as F

    rows = [(1, "the hat"), (2, "und die"), (3, None), (4, ""), (5, "12 !?"), (6, "zzz \u00fc"), (8, "die " * 5000)]
    df = documents(rows).withColumn("_bits", F.lit("mine"))
    learned = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    one, many = (ppm.identify(df, ppm.learn(learned, size)).orderBy("doc_id").collect() for size in (1 << 30, 900))
    assert [r["_bits"] for r in many] == ["mine"] * len(rows)
    for a, b in zip(one, many, strict=True):
        assert a["lang_pred"] == b["lang_pred"]
        assert (a["score"], a["bits"]) == pytest.approx((b["score"], b["bits"]))
    model = ppm.learn(learned)
    texts = [r[1] for r in rows]
    whole = lengths(model, texts)
    monkeypatch.setattr(ppm, "_PIECE", 7)
    assert lengths(model, texts) == pytest.approx(whole)


def test_predictions_and_defined_cases(documents, model):
    from pyspark.sql import functions as F

    rows = [(1, "the hat"), (2, "und die"), (3, None), (4, ""), (5, "12 !?"), (None, "the"), (1, "the hat"), (8, "die " * 5000)]
    df = documents(rows).withColumn("Score", F.lit("mine"))
    out = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in ppm.identify(df, model).collect()}
    assert out[1, "the hat"][0] == "en" and out[2, "und die"][0] == "de" and out[None, "the"][0] == "en"
    for key in ((3, None), (4, ""), (5, "12 !?")):
        assert out[key] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in out.values())


def test_nothing_learned(documents):
    assert ppm.learn(documents([(1, None, "en")])) is None
    assert [r["lang_pred"] for r in ppm.identify(documents([(1, "abc")]), None).collect()] == ["und"]
    assert ppm.identify(documents([]), None).count() == 0


def test_long_texts_cross_step_borders(model):
    text = "der hund und die katze " * 300
    whole = lengths(model, [text, "a", text])
    assert whole[0] == pytest.approx(whole[2]) and (whole[0] > 100 * whole[1]).all()


def test_held_out_accuracy(spark):
    from agriclime.llm import queries

    out = queries.op9_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
