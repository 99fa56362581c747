import pytest

from agriclime.operators import coverage, edges

KEYS = ["station", "year"]


def frame(spark, n):
    # Deliberately unordered; the last two groups have a missing key.
    rows = [(i // 4, 2000 + i % 4, i) for i in range(n - 2)] + [(None, 2000, n - 2), (None, None, n - 1)]
    return spark.createDataFrame(rows[::-1], "station int, year int, v int")


def test_trim(spark):
    df = frame(spark, 8)
    kept = sorted(r.v for r in edges.trim_edge_groups(df, KEYS).collect())
    assert kept == [5, 6]


@pytest.mark.parametrize("limit", [10_000, 3])
def test_drop_row_at(spark, monkeypatch, limit):
    monkeypatch.setattr(edges, "TOP_N_LIMIT", limit)
    df = frame(spark, 50)
    for n in (1, 4, 23, 50):
        kept = sorted(r.v for r in edges.drop_row_at(df, KEYS, n).collect())
        assert kept == [v for v in range(50) if v != n - 1]
    for n in (0, 51, 45446):
        assert edges.drop_row_at(df, KEYS, n).count() == 50


@pytest.mark.parametrize("limit", [10_000, 2])
def test_long_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(edges, "TOP_N_LIMIT", limit)
    df = frame(spark, 60)
    kept = sorted(r.v for r in edges.trim_edge_groups(df, KEYS, 20, 7).collect())
    assert kept == list(range(20, 53))
    assert edges.trim_edge_groups(df, KEYS, 50, 20).count() == 0


def test_twenty_thousand_rows_are_trimmed(spark):
    df = spark.range(50_000).selectExpr("cast(id as int) station", "2000 year", "cast(id as int) v")
    kept = edges.trim_edge_groups(df, KEYS, 20_000, 1).selectExpr("min(v) a", "max(v) b", "count(*) n").first()
    assert tuple(kept) == (20_000, 49_998, 29_999)


def test_coverage_forms_agree(spark):
    rows = [(s, 2000 + y, m) for s in (3, 7, 101) for y in range(2) for m in (1, 2) if (s + y + m) % 3]
    rolled = spark.createDataFrame(rows, "station int, year int, month int")
    time = ["year", "month"]
    cells = {tuple(r) for r in coverage.coverage_long(rolled, time).collect()}
    assert cells == {(y, m, s, 1) for s, y, m in rows}
    matrix = coverage.coverage_matrix(rolled, time, [3, 7, 101])
    assert matrix.columns == ["year", "month", "3", "7", "101"]
    from_matrix = {
        (r.year, r.month, s, r[str(s)]) for r in matrix.collect() for s in (3, 7, 101)
        if r[str(s)] is not None
    }
    tiles = coverage.coverage_tiles(rolled, time, 50)
    from_tiles = {
        (r.year, r.month, r.tile * 50 + j, r[f"s{j}"]) for r in tiles.collect() for j in range(50)
        if r[f"s{j}"] is not None
    }
    assert from_matrix == from_tiles == cells
    sums = {(r.year, r.month): r.station_num for r in coverage.station_count(rolled, time).collect()}
    for (y, m), n in sums.items():
        assert n == sum((y, m) == (a, b) for a, b, _, _ in cells)


def test_wind_counts(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (None,), (float("nan"),)], "ws_avg double")
    row = coverage.wind_profile(df).first()
    assert (row.ws_avg_mean, row.ws_avg_max, row.n_gt, row.n_gt_or_null) == (9.5, 10.0, 1, 3)


@pytest.mark.parametrize("positions", [[1, 2, 3, 4, 5, 150, -1], [], [0, 301, -301, 10**9], range(1, 301), [-300, -2, 7, 7]])
def test_several_positions_at_once(spark, positions):
    """Also across slices, from the end, missing, repeated, and all of them; null keys last."""
    rows = [(i % 7 if i % 11 else None, i, i * 1.5) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, v double").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    gone = {p if p > 0 else 301 + p for p in positions if p}
    kept = edges.drop_rows_at(df, ["a", "b"], positions)
    assert {tuple(r) for r in kept.collect()} == {r for i, r in enumerate(order, 1) if i not in gone}
    found = {(r["a"], r["b"]): r["ordinal"] for r in edges.rows_at(df, ["a", "b"], positions).collect()}
    assert found == {order[i - 1][:2]: i for i in gone if 1 <= i <= 300}


def test_positions_share_one_range_shuffle(spark, monkeypatch):
    made, real = [], edges.materialize

    def seen(df, label):
        made.append(df._jdf.queryExecution().executedPlan().toString().count("rangepartitioning"))
        return real(df, label)

    monkeypatch.setattr(edges, "materialize", seen)
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert edges.drop_rows_at(df, ["k"], [1, 2, 500, -1]).count() == 996
    assert sum(made) == 1
    assert edges.drop_rows_at(df.limit(0), ["k"], [1, -1]).count() == 0
