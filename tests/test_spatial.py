import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agriclime.operators import interpolate as ip
from agriclime.operators import spatial

STATION = "station int, latitude double, longitude double"
REGION = "wide string, region string, lat double, lng double"
OBS = (
    "station int, year int, month int, tm_avg double, tm_min double, tm_max double, "
    "pr_sum double, hm_avg double, ss_dura double"
)


def brute_force(regions, stations, k):
    out = {}
    for wide, region, lat, lng in regions:
        if lat is None or lng is None:
            continue
        ranked = sorted(
            (float(np.sqrt((a - lat) * (a - lat) + (b - lng) * (b - lng))), s)
            for s, a, b in stations
            if a is not None and b is not None
        )[:k]
        out[wide, region] = [(i, s, d) for i, (d, s) in enumerate(ranked, 1)]
    return out


def run(spark, regions, stations, k):
    df = spatial.nearest_stations(
        spark.createDataFrame(regions, REGION), spark.createDataFrame(stations, STATION), k
    )
    out = {}
    for r in df.orderBy("wide", "region", "rank").collect():
        out.setdefault((r.wide, r.region), []).append((r.rank, r.station, r.dist))
    return out


def layout(kind, rnd, n):
    if kind == "uniform":
        return [(rnd.uniform(33, 39), rnd.uniform(125, 130)) for _ in range(n)]
    if kind == "lattice":  # many equal distances and shared places
        return [(33 + rnd.randrange(8), 126 + rnd.randrange(8)) for _ in range(n)]
    if kind == "cluster":  # two dense spots far from an outlier
        return [(0.0, 0.0)] + [
            (c + rnd.gauss(0, 0.01), 120 + c + rnd.gauss(0, 0.01))
            for c in (rnd.choice((10, 40)) for _ in range(n - 1))
        ]
    if kind == "one_place":  # a third of everything in one spot
        return [(35.0, 127.0) if i % 3 else (rnd.uniform(34, 36), 127.5) for i in range(n)]
    if kind == "line":
        return [(35.0, rnd.uniform(125, 130)) for _ in range(n)]
    return [(35.0, 127.0)] * n


@pytest.mark.parametrize("kind", ["uniform", "lattice", "cluster", "one_place", "line", "point"])
@pytest.mark.parametrize("n", [4, 700])
def test_equals_all_pairs(spark, kind, n):
    rnd = random.Random(f"{kind}{n}")
    stations = [(i * 7 % 1009, float(a), float(b)) for i, (a, b) in enumerate(layout(kind, rnd, n))]
    stations.append((5000, None, 127.0))
    points = layout(kind, rnd, 20) + [(rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for _ in range(8)]
    regions = [(f"w{i % 3}", f"r{i}", float(a), float(b)) for i, (a, b) in enumerate(points)]
    regions += [("w0", "twin", *regions[0][2:]), ("w0", "nowhere", None, 127.0)]
    assert run(spark, regions, stations, 10) == brute_force(regions, stations, 10)


def test_deep_grid_is_exact(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_CAPACITY", 1)
    rnd = random.Random(5)
    stations = [(i, *p) for i, p in enumerate(layout("cluster", rnd, 400))]
    regions = [("w", f"r{i}", *p) for i, p in enumerate(layout("cluster", rnd, 40))]
    assert run(spark, regions, stations, 3) == brute_force(regions, stations, 3)


def depth(spark, places):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in places], "latitude double, longitude double")
    grid = spatial._Grid.of(df)
    return grid.levels_needed(grid.located(df))


def test_one_far_place_costs_no_level(spark):
    """Cuts follow the places: neither an outlier nor a dense spot makes the grid deeper."""
    rnd = random.Random(6)
    near = [(35 + rnd.random() * 4, 126 + rnd.random() * 4) for _ in range(4000)]
    dense = [(35 + rnd.random() * 5e-5, 126 + rnd.random() * 5e-5) for _ in range(4000)]
    assert depth(spark, near) == depth(spark, [*near, (-60.0, -170.0)]) == 2
    assert depth(spark, dense) == depth(spark, [*dense, (80.0, 170.0)]) == 2
    assert spatial._Grid.of(spark.createDataFrame([], "latitude double, longitude double")) is None


def test_dense_places_are_exact(spark):
    rnd = random.Random(7)
    stations = [(i, 35 + rnd.random() * 5e-5, 126 + rnd.random() * 5e-5) for i in range(3000)] + [(9999, -60.0, -170.0)]
    regions = [("w", f"r{i}", 35 + rnd.random() * 5e-5, 126 + rnd.random() * 5e-5) for i in range(20)] + [("w", "far", -59.0, 100.0)]
    assert run(spark, regions, stations, 5) == brute_force(regions, stations, 5)


def test_plan_has_no_all_pairs_join(spark):
    stations = spark.createDataFrame([(i, 33.0 + i % 89, 120.0 + i % 97) for i in range(3000)], STATION)
    regions = spark.createDataFrame([("w", "r", 40.0, 130.0)], REGION)
    text = spatial.nearest_stations(regions, stations)._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text and "Cross" not in text


ONE = [("w", "r", 0.0, 0.0)]
FOUR = [(i, 0.0, float(i)) for i in range(1, 5)]
VALUES = {1: 10.0, 2: 20.0, 3: 40.0, 4: 80.0}


def one_cell(spark, regions, stations, schema=STATION, geo=None):
    from agriclime.functions.calendar import calendar_parts
    from agriclime.plans.interpolation import interpolate_region_climate

    rows = [(s, "2001-05-01", v, v, v, v, v, v, v) for s, v in VALUES.items()]
    daily = calendar_parts(spark.createDataFrame(rows, (
        "station int, date string, tm_avg double, tm_min double, tm_max double, pr_day double, "
        "hm_avg double, ss_dura_sum double, rad_sum double")))
    regions = spark.createDataFrame(regions, REGION) if geo is None else spark.createDataFrame(regions, "wide string, region string")
    out = interpolate_region_climate(
        daily, regions, spark.createDataFrame(stations, schema), 2001, 2001,
        geo=None if geo is None else spark.createDataFrame(geo, REGION))
    return {r.region: r.tm_avg for r in out.where("month = 5").collect()}


def test_one_row_of_everything(spark):
    assert one_cell(spark, ONE, FOUR)["r"] == pytest.approx(18.1818, abs=1e-3)


def test_double_rows_raise(spark):
    with pytest.raises(Exception, match="more than one row for a region"):
        one_cell(spark, ONE * 2, FOUR)
    with pytest.raises(Exception, match="more than one row for a station"):
        one_cell(spark, ONE, [*FOUR, FOUR[0]])
    with pytest.raises(Exception, match="more than one coordinate row"):
        one_cell(spark, [("w", "r")], FOUR, geo=[*ONE, ("w", "r", 5.0, 5.0)])


def test_station_history_counts_once(spark):
    history = [(*s, "1990-01-01") for s in FOUR] + [(1, 0.0, 0.5, "1980-01-01"), (2, 0.5, 0.0, "1981-01-01")]
    found = one_cell(spark, ONE, history, STATION + ", date_start string")
    assert found["r"] == pytest.approx(18.1818, abs=1e-3)


def test_region_without_coordinates_keeps_its_rows(spark):
    found = one_cell(spark, [("w", "r"), ("w", "new")], FOUR, geo=ONE)
    assert found["new"] is None and found["r"] == pytest.approx(18.1818, abs=1e-3)


def test_a_station_listed_twice_counts_once(spark):
    near = [("w", "r", 1, 1, 1.0), ("w", "r", 2, 1, 1.0), ("w", "r", 3, 2, 2.0), ("w", "r", 4, 3, 3.0)]
    obs = [(s, 2001, 5, *[VALUES[s]] * 6) for s in (1, 2, 3)]
    chosen = ip.nearest_reporting(spark.createDataFrame(near, NEIGHBOURS), spark.createDataFrame(obs, OBS))
    assert sorted((r.place, r.station) for r in chosen.collect()) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("odd", [(9000, 1e9, 127.0), (9000, float("inf"), float("-inf")), (9000, 35.0, 181.0)])
def test_coordinates_that_are_none_change_nothing(spark, odd):
    rnd = random.Random(6)
    stations = [(i, *p) for i, p in enumerate(layout("uniform", rnd, 600))]
    regions = [("w", f"r{i}", *p) for i, p in enumerate(layout("uniform", rnd, 10))]
    assert run(spark, regions, [*stations, odd], 10) == brute_force(regions, stations, 10)
    frame = spark.createDataFrame([*stations, odd], STATION)
    assert spatial.station_places(frame, 10).count() == 600


def test_no_stations_at_all(spark):
    assert run(spark, [("w", "r", 1.0, 1.0)], [(1, None, None)], 3) == {}


def test_wide_form_is_null_past_the_last_neighbour(spark):
    near = spatial.nearest_stations(
        spark.createDataFrame([("w", "r", 0.0, 0.0)], REGION),
        spark.createDataFrame([(7, 3.0, 4.0), (9, 0.0, 1.0)], STATION),
    )
    row = spatial.neighbours_wide(near).first()
    assert (row.st1, row.dist1, row.st2, row.dist2, row.st3, row.dist10) == (9, 1.0, 7, 5.0, None, None)


# Interpolation: one region with ten neighbours at distance 1..10, stations 20, 19, ..
NEIGHBOURS = "wide string, region string, rank int, station int, dist double"


def chosen_value(spark, reporting, pairing="aligned", dist=lambda r: float(r), value=None):
    near = [("w", "r", r, 21 - r, dist(r)) for r in range(1, 11)]
    value = value or (lambda r: float(r))
    obs = [(21 - r, 2001, 5, value(r), 1.0, 1.0, 1.0, 1.0, 1.0) for r in reporting]
    grid = spark.createDataFrame([("w", "r", 2001, 5)], "wide string, region string, year int, month int")
    out = ip.interpolate(
        spark.createDataFrame(near, NEIGHBOURS), spark.createDataFrame(obs, OBS), grid,
        pairing=pairing,
    ).collect()
    assert len(out) == 1
    return out[0].tm_avg, out[0].tm_min


def weighted(values, distances):
    return sum(v / d for v, d in zip(values, distances)) / sum(1 / d for d in distances)


@pytest.mark.parametrize("reporting", [(1, 2, 3), (4, 5, 6), (2, 7, 9, 10), (3, 10), (8,)])
def test_nearest_three_that_report(spark, reporting):
    used = reporting[:3]
    got, _ = chosen_value(spark, reporting)
    assert got == pytest.approx(weighted(used, used))
    assert min(used) <= got <= max(used)


def test_nobody_reports(spark):
    assert chosen_value(spark, ()) == (None, None)


def test_literal_widening_search_agrees(spark):
    rnd = random.Random(1)
    for _ in range(6):
        reporting = sorted(rnd.sample(range(1, 11), rnd.randint(1, 6)))
        k = 3
        while k < 10 and sum(r <= k for r in reporting) != 3:
            k += 1
        used = [r for r in reporting if r <= k]
        assert chosen_value(spark, reporting)[0] == pytest.approx(weighted(used, used))


def test_station_on_the_spot(spark):
    assert chosen_value(spark, (1, 2, 3), dist=lambda r: r - 1.0)[0] == 1.0
    assert chosen_value(spark, (1, 2, 3), "station_order", dist=lambda r: r - 1.0)[0] is None


def test_missing_measure_of_a_chosen_station(spark):
    got = chosen_value(spark, (1, 2, 3), value=lambda r: None if r == 2 else float(r))
    assert got == (None, 1.0)


def test_pairing_modes_differ_and_agree_for_one_station(spark):
    # Station numbers run against the distance, so the values come in reverse.
    assert chosen_value(spark, (1, 2, 3))[0] == pytest.approx(weighted((1, 2, 3), (1, 2, 3)))
    assert chosen_value(spark, (1, 2, 3), "station_order")[0] == pytest.approx(
        weighted((3, 2, 1), (1, 2, 3))
    )
    assert chosen_value(spark, (4,)) == chosen_value(spark, (4,), "station_order")


def test_grid_is_complete(spark):
    regions = spark.createDataFrame([("w", "a"), ("w", "b")], "wide string, region string")
    assert ip.region_grid(regions, 2000, 2021).count() == 2 * 22 * 12
    assert ip.region_grid(regions, 2000, 2001, "tenday").count() == 2 * 2 * 36
    half = ip.region_grid(regions, 2000, 2000, "half")
    assert half.agg(F.count_distinct("year", "month", "half")).first()[0] == 24
