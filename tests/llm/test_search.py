import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agriclime.llm import licenses, neighbours, queries
from agriclime.llm.curves import positions


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = positions(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def exact(rows, k):
    good = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in good:
        if q % 20 == 0:
            ranked = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def test_small_table_is_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 3)).tolist()) for i in range(160)]
    rows[33] = (33, rows[34][1])  # a tie
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] * 8)]
    odd += [(1004, [float("inf")] + [0.0] * 7), (1005, []), (1006, [1.0] * 5), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "v": F.lit(2)})
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = exact(rows, 20)
    assert set(found) == set(expected)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.95 * 20 * len(expected)
    vectors = dict(rows)
    for q, own in found.items():
        assert len(own) == 20 and all(i != q for i, _ in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        for i, score in own:
            assert score == pytest.approx(np.dot(vectors[q], vectors[i]), rel=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(0, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [2.0, 1.0])]])
def test_hardly_any_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect() == []


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)] + [(2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, F.col("vec_id") == 0).collect()]
    assert sorted(found) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_ties_of_many_copies_go_to_the_least_ids(spark):
    rng = np.random.default_rng(5)
    hot = [3.0, 0.0, 0.0, 0.0]
    rows = [(i, hot if i % 3 else rng.normal(size=4).tolist()) for i in rng.permutation(900).tolist()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    expected = exact(rows, 20)
    assert set(found) == set(expected)
    copies = [q for q in expected if q % 3]
    assert len(copies) == 30 and all(found[q] == [i for i, _ in expected[q]] for q in copies)


def test_equal_scores_at_the_cut_are_kept_by_id():
    ids = np.random.default_rng(2).permutation(800)
    q, c = np.array([[1.0, 0.0]]), np.column_stack([np.ones(800), ids])
    _, column, score = neighbours._best(q @ c.T, 20, q, c, ids)
    assert ids[column].tolist() == list(range(20)) and (score == 1).all()


def test_recall_on_sample_table(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    expected = exact(list(zip(table.vec_id, table.embedding)), 20)
    found = {}
    for r in queries.op4_neighbours(spark, folder).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = [len(found[q] & {i for i, _ in own}) / 20 for q, own in expected.items()]
    assert np.mean(recall) >= 0.9


def brute_licenses(text):
    import re

    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = {}
    for name, notice in licenses.NOTICES.items():
        own = re.findall(r"[a-z0-9]+", notice.lower())
        shingle = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        best = max((len(shingle(own) & shingle(words[i : i + len(own)])) / len(shingle(own)) for i in range(len(words) - len(own) + 1)), default=0)
        if best >= licenses.CONTAINED:
            found[name] = best
    return found


def test_licenses_equal_brute_force(documents):
    grant = licenses.NOTICES["MIT-grant"]
    texts = [
        grant, "x y " + grant.upper().replace(" ", "\n") + " z", grant.replace("granted", "given"), grant[:100],
        "é Released under the MIT License.", "released UNDER the mit-license é", "Released under the BSD License", None, "",
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "word " * 30_000 + licenses.NOTICES["GPL-3.0"],
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[4])]
    out = licenses.scan(documents(rows).withColumn("LICENSES", F.lit(1))).collect()
    assert len(out) == len(rows)
    for r in out:
        got = {m["license"]: m["containment"] for m in r["licenses"]}
        assert got == pytest.approx(brute_licenses(r["text"]))
    mit = next(r for r in out if r["doc_id"] == 4)["licenses"][0]
    assert texts[4][mit["start"] : mit["end"]] == "Released under the MIT License"
    assert licenses.scan(documents([])).count() == 0


def test_own_templates(documents):
    df = documents([(1, "alpha beta gamma delta"), (2, "alpha"), (3, "beta gamma delta epsilon")])
    notices = {"one": "alpha", "four": "Alpha, beta gamma delta", "none": "?!"}
    found = {r["doc_id"]: [m["license"] for m in r["licenses"]] for r in licenses.scan(df, notices).collect()}
    assert found == {1: ["four", "one"], 2: ["one"], 3: []}
    assert licenses.chance(licenses.CONTAINED / (2 - licenses.CONTAINED)) > 1 - 1e-6
    assert licenses.Templates(notices).scan(pa.array([""])) == [[]]
