import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from agriclime.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(bpe.Vocabulary.read(bpe.vocabulary_content(PATH)))
TEXTS = [
    "", " ", "\n\n  x\t", "Hello world, it's 12345 o'clock!!", "é" * 50, "中文 \U0001f600 ﬀ", "a" * 700,
    "ab" * 400 + "!" * 99, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "don't DON'T we'll",
]


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(text):
    packed = ENCODER.encode([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == expected(text)
    assert ENCODER.vocabulary.decode(packed) == LIBRARY.decode(expected(text), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_library_on_any_text(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="the an", min_size=1, max_size=80))
def test_short_and_long_merging_agree(text):
    vocabulary = ENCODER.vocabulary
    assert vocabulary._merge_short(text.encode()) == vocabulary._merge_long(text.encode())


def test_guess_fails_on_some_words_and_they_are_merged():
    words = [" unhappiness", " thedanble", " antidisestablishment", " ererst"]
    guessed = [ENCODER.vocabulary.guess(w.encode()) for w in words]
    assert any(g != expected(w) for g, w in zip(guessed, words))


def test_bounded_cache_changes_nothing():
    small = bpe.Encoder(ENCODER.vocabulary, cache_words=3)
    assert [small.encode([t])[0] for t in TEXTS] == ENCODER.encode(TEXTS)


def test_rows_nulls_and_clashing_columns(documents):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (0, ""), (None, "a b")]
    df = documents(rows).withColumn("IDS", F.lit(1))
    out = bpe.encode_decode(df, bpe.vocabulary_content(PATH)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == expected(r["text"] or "")
        assert r["n_tokens"] == len(expected(r["text"] or "")) and r["decoded"] == (r["text"] or "")
    assert bpe.encode_decode(documents([]), bpe.vocabulary_content(PATH)).count() == 0


def test_words_met_again_outlive_a_full_half():
    small = bpe.Encoder(ENCODER.vocabulary, cache_words=8)
    texts = [f"often {chr(97 + i)}x{i} {chr(97 + i)}y{i} {i}" for i in range(20)]
    assert [small.encode([t])[0] for t in texts] == ENCODER.encode(texts)
    assert "often" in small.cache or "often" in small.before
    assert len(small.cache) + len(small.before) <= 30


def test_text_rows_are_set_for_the_write_alone(spark, documents):
    from agriclime.llm.common import TEXT_ROWS, store

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    df = documents([(i, "text") for i in range(5000)]).coalesce(1)
    found = store(df.mapInArrow(sizes, "n long"), "sizes", TEXT_ROWS)
    assert max(r["n"] for r in found.collect()) <= TEXT_ROWS and spark.conf.get(name) == before
