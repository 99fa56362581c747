from collections import Counter

from pyspark.sql import functions as F

from agriclime.llm import sharding

def size():
    return sharding.record_bytes(F.col("text"))



def placed(df, count, seed=7):
    return [r.asDict() for r in sharding.shards(df, count, ["doc_id"], size(), seed).collect()]


def test_counts_are_even_and_slots_gapless(documents):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 40)) for i in range(500)] + [(3, "again"), (None, ""), (None, "x")]
    out = placed(documents(rows), 16)
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))


def test_many_buckets_make_one_gapless_order(documents):
    df = documents([(i, "text") for i in range(300)])
    out = sharding.external_shuffle(df, ["doc_id"], size(), 1, bucket_bytes=64)
    assert sorted(r["position"] for r in out.collect()) == list(range(300))


def test_seed_decides_the_order(documents):
    df = documents([(i, "t") for i in range(200)])
    order = lambda seed: [(r["doc_id"], r["shard"], r["slot"]) for r in sorted(placed(df, 4, seed), key=lambda r: r["doc_id"])]
    assert order(1) == order(1) != order(2)


def test_copies_of_one_text_spread(documents):
    out = placed(documents([(i, "the same") for i in range(320)]), 16)
    assert Counter(Counter(r["shard"] for r in out).values()) == {20: 16}


def test_empty_table_and_clashing_columns(documents):
    assert placed(documents([]), 16) == []
    df = documents([(1, "a"), (2, "b")]).withColumns({"Shard": F.lit("x"), "slot": F.lit("y"), "position": F.lit(0)})
    out = sharding.shards(df, 2, ["doc_id"], size())
    assert sorted(r["shard"] for r in out.collect()) == [0, 1]


def test_written_shards_hold_all_rows(spark, documents, tmp_path):
    df = sharding.shards(documents([(i, "t") for i in range(40)]), 4, ["doc_id"], size())
    sharding.write_shards(df, str(tmp_path / "out"))
    assert Counter(r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == {k: 10 for k in range(4)}


def test_main_path_has_no_python(documents):
    plan = sharding.shards(documents([(1, "a")]), 2, ["doc_id"], size())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
