import hashlib

import duckdb
import numpy as np
import pytest
from test_decontaminate import least_distance
from test_lines import brute as line_brute
from test_near_duplicates import brute as near_brute
from test_repeats import brute as repeat_brute

import corpus_pipeline
from agriclime.llm import decontaminate, ppm, queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), "test-stage")
        out[name] = (docs.columns, docs.collect())
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "repeated_lines", "near_duplicates", "decontamination", "tokens"
    ]


def untouched(item, edits, text):
    """Whether one of ``edits`` + 1 parts of the item stands in the text, as it must within so many edits."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return any(item[a:b] in text for a, b in zip(cuts, cuts[1:]))


def test_every_stage_equals_brute_force(stages):
    columns, rows = stages["language"]
    assert columns == COLUMNS and {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages["input"]}
    before = sorted(rows, key=lambda r: r["doc_id"])
    columns, rows = stages["repeated_lines"]
    assert columns == COLUMNS
    texts = [(r["doc_id"], r["text"]) for r in before]
    places, group = line_brute(texts)
    first = {}
    for row, k, form in places:
        first.setdefault(group[form], (row, k))
    gone = {(row, k) for row, k, form in places if first[group[form]] != (row, k)}
    kept = {
        doc: "\n".join(line for k, line in enumerate(text.split("\n")) if (row, k) not in gone)
        for row, (doc, text) in enumerate(texts)
    }
    assert {r["doc_id"]: r["text"] for r in rows} == kept and gone
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    classes = near_brute(list(kept.items()))
    columns, rows = stages["near_duplicates"]
    assert columns == COLUMNS and {r["doc_id"] for r in rows} == {i for i, c in classes.items() if i == c}
    before = {r["doc_id"]: r["text"] for r in rows}
    columns, rows = stages["decontamination"]
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    items = [decontaminate.normal(x) for _, x in items]
    assert min(map(len, items)) >= decontaminate.MIN_BYTES  # shorter ones: test_decontaminate
    texts = {i: decontaminate.normal(t) for i, t in before.items()}
    near = {
        i
        for i, t in texts.items()
        if any(untouched(x, k, t) and least_distance(x, t) <= k for x in items for k in [int(decontaminate.RATE * len(x))])
    }
    left = {r["doc_id"] for r in rows}
    assert columns == COLUMNS and left == set(before) - near and near
    columns, rows = stages["tokens"]
    assert {r["doc_id"] for r in rows} == left and all(r["round_trip"] for r in rows)
    assert all(r["n_tokens"] == len(np.frombuffer(bytes(r["ids"]), "<u4")) for r in rows)


def test_run_equals_the_stages(spark, stages):
    found = {r["doc_id"]: bytes(r["ids"]) for r in queries.pipeline(spark, FOLDER).collect()}
    assert found == {r["doc_id"]: bytes(r["ids"]) for r in stages["tokens"][1]}
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("known", [True, False])
def test_odd_rows_pass_all_stages(spark, documents, tmp_path, known):
    rows = [(1, None, "en"), (2, "", "en"), (9, "the cat sat on the mat with the hat", "en"), (9, "the cat sat on the mat with the hat", "en")]
    rows += [(None, "the dog ran over the hill and the road", "en"), (4, "12 !!", None), (10, "der hund und die katze im haus am berg", "de")]
    rows = [(i, t, lang if known else None) for i, t, lang in rows]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test-odd")
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["10", "9", "9", "None"]


def test_empty_table(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_registered_queries():
    names = sorted(queries.registered())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert set(queries.oracle()) <= set(names)


def test_near_duplicates_equal_sql(spark):
    from compare import connect, difference

    with connect(FOLDER) as con:
        assert difference(queries.op2_minhash(spark, FOLDER), con, queries.oracle()["op2_minhash"]) is None


def test_repeats_equal_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    found = {r["doc_id"]: r for r in queries.op10_suffix_dedup(spark, FOLDER).collect()}
    for doc, n, gone, runs, kept in repeat_brute(rows):
        r = found[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, gone, runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_language_of_a_learned_value(spark):
    out = queries.op9_language_id(spark, FOLDER).collect()
    assert {r["lang_pred"] for r in out} <= {"de", "en", "es", "fr", ppm.UNKNOWN}
