import itertools

import numpy as np
import pyarrow as pa
import pytest

from agriclime.llm import crf, queries


def brute_marginals(score, transition):
    """All state sequences of one text that begins after the clean state."""
    total, toxic = 0.0, np.zeros(len(score))
    for states in itertools.product((0, 1), repeat=len(score)):
        weight, before = 1.0, 0
        for t, s in enumerate(states):
            weight *= np.exp(transition[before, s] + s * score[t])
            before = s
        total += weight
        toxic += weight * np.array(states)
    return toxic / total


def test_marginals_equal_all_sequences(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(crf, "_CHUNK", 3)
    transition = rng.normal(size=(2, 2))
    lengths = [0, 1, 2, 3, 4, 10, 0, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score = rng.normal(size=first[-1]) * 3
    found = crf.marginals(score, first, transition)
    for a, b in zip(first, first[1:]):
        assert found[a:b] == pytest.approx(brute_marginals(score[a:b], transition))


def test_fit_learns_separable_labels():
    rng = np.random.default_rng(4)
    cue = np.where(rng.random((80, 20)) < 0.1, 4.0, 0.0)
    edge = np.zeros(cue.shape, bool)
    edge[:, 0] = True
    features = crf._emissions(cue.ravel(), edge.ravel()).reshape(80, 20, 4).astype(float)
    held = np.ones(cue.shape, bool)
    held[:10, 12:] = False
    theta, transition = crf.fit_field(features, cue > 0, held)
    p = crf.marginals((features[20:] @ theta).ravel(), np.arange(0, 61 * 20, 20), transition).reshape(60, 20)
    assert ((p > 0.5) == (cue[20:] > 0)).mean() > 0.99


def corpus():
    rng = np.random.default_rng(6)
    words = ["river", "stone", "under", "green", "table", "winter", "music", "paper"]
    docs, labels = [], []
    for i in range(240):
        own = list(rng.choice(words, rng.integers(3, 40)))
        toxic = i % 3 == 0
        if toxic:
            for w in rng.choice(["grumblefool", "Nastyword"], 3):
                own.insert(int(rng.integers(len(own))), str(w))
        docs.append((i, " ".join(own) + f" {i}"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    from pyspark.sql import functions as F

    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = crf.learning_rows(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    return crf.learn(rows)


def test_scores_and_spans(documents, model):
    from pyspark.sql import functions as F

    rows = [(1, "you grumblefool, you Nastyword grumblefool"), (2, "the green river under winter music"), (3, None), (4, "")]
    rows += [(5, "12 34 !"), (None, "é nastyword nastyword grumblefool"), (1, "paper " * 20_000)]
    out = crf.score(documents(rows).withColumn("SCORE", F.lit("mine")), model).collect()
    by = {(r["doc_id"], (r["text"] or "")[:3]): r for r in out}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert by[1, "you"]["score"] > 0.5 > by[2, "the"]["score"] and by[None, "é n"]["score"] > 0.5
    assert by[1, "pap"]["score"] < 0.5 and by[3, ""]["score"] < 0.5 and by[4, ""]["n_words"] == 0
    for r in out:
        found = [r["text"][s["start"] : s["end"]].lower() for s in r["spans"]]
        assert set(found) <= {"grumblefool", "nastyword"}
    assert len(by[None, "é n"]["spans"]) == 3


def test_cues_and_sample_hold_rare_toxic_texts(spark, documents):
    rng = np.random.default_rng(9)
    words = ["river", "stone", "under", "green", "table", "winter", "music", "paper"]
    usual = lambda: " ".join(rng.choice(words, 12))
    rows = [(i, f"{usual()} {i}", 0) for i in range(3000)]
    rows += [(3000 + i, f"{usual()} grumblefool {i}", 1) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = crf.learn(df, sample=40)  # a blind draw holds no toxic text more often than not
    out = {r["doc_id"]: r["score"] for r in crf.score(documents([(1, usual() + " grumblefool"), (2, usual())]), model).collect()}
    assert out[1] > 20 * out[2], out  # the ridge keeps ten texts well under certainty


def test_support_does_not_grow_with_the_texts():
    # 900 of 200,000 toxic texts and no clean one; seven of seven at a share of a tenth; three of three
    sure = np.log(crf.CHANCE / crf.BUCKETS)
    assert crf._by_chance(np.array([900]), np.array([0]), 0.5)[0] < sure
    assert crf._by_chance(np.array([3, 7]), np.array([0, 0]), 0.1) == pytest.approx(np.array([3, 7]) * np.log(0.1))
    assert crf._by_chance(np.array([1]), np.array([99]), 0.1)[0] == 0


def test_nothing_to_learn(spark, documents):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a b"), (2, "c d"), (2, "c d"), (3, None)])
    assert crf.learn(crf.learning_rows(docs, empty, F.lit(True))) is None
    assert crf.learn(crf.learning_rows(docs, odd, F.lit(True))) is None
    assert [r["score"] for r in crf.score(docs, None).collect()] == [0.0] * 4
    assert crf.score(documents([]), None).count() == 0


def test_lower_case():
    data = np.frombuffer("ÀÉÖ×ß Aé".encode(), np.uint8)
    assert crf._lower(data).tobytes().decode() == "àéö×ß aé"
    assert crf._features(pa.array(["", None]))[2].shape[1] == 0


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
