"""Stations that move: what holds on a day, against all pairs."""

import math
import random

import pytest

from agriclime.operators import history

STATION = "station int, date_start string, latitude double, longitude double, wide string, station_name string, region string"
REGION = "wide string, region string, lat double, lng double"
STARTS = [None, "1990-01-01", "1995-05-15", "2000-01-01", "2000-01-01", "2003-12-31"]


def moves(seed, n=60, entries=4):
    draw = random.Random(seed)
    out = []
    for s in range(n):
        for e in range(draw.randint(1, entries)):
            place = (draw.choice([35.0, draw.uniform(33, 39)]), draw.uniform(125, 130))
            out.append((s, draw.choice(STARTS), *place, f"w{e}", f"s{s}_{e}", f"r{draw.randint(0, 9)}"))
    return out


def holding(rows, station, day):
    own = [r for r in rows if r[0] == station and (r[1] or "") <= day]
    return max(own, key=lambda r: (r[1] or "", r[2:]), default=None)


@pytest.mark.parametrize("entries", [1, 4])
def test_the_entry_of_the_day_is_joined(spark, entries):
    rows = moves(1, entries=entries)
    stations = spark.createDataFrame(rows, STATION)
    days = ["1980-01-01", "1990-01-01", "1995-05-14", "1995-05-15", "2001-07-01", "2024-02-29", None]
    daily = [(s, d, "old") for s in [*range(60), 99, None] for d in days]
    df = spark.createDataFrame(daily, "station int, date string, region string")
    got = {(r["station"], r["date"]): r["station_name"] for r in history.station_join_as_of(df, stations).collect()}
    assert len(got) == len(daily)
    for s, d, _ in daily:
        entry = holding(rows, s, d) if d is not None else None
        assert got[s, d] == (entry[5] if entry else None)


def test_as_of_join_neither_fans_out_nor_sorts_the_weather(spark):
    stations = spark.createDataFrame(moves(2), STATION)
    daily = spark.range(1000).selectExpr("cast(id % 60 as int) station", "'2001-01-01' date")
    joined = history.station_join_as_of(daily, stations)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000 and "Window" not in text and "rangepartitioning" not in text


@pytest.mark.parametrize("k, entries", [(3, 4), (10, 2), (70, 3)])
def test_neighbours_of_every_time(spark, monkeypatch, k, entries):
    """All pairs on each side of each break; places left long ago make the lists grow."""
    rows = moves(3, entries=entries)
    # Thirty stations have all left the same spot: a short list there holds none that stays.
    rows += [(100 + i, d, *p, "w", f"m{i}", "r") for i in range(30) for d, p in (("1990-01-01", (36.0, 127.0)), ("1991-01-01", (60.0, 20.0)))]
    regions = [("w", "spot", 36.0, 127.001), ("w", "a", 34.0, 126.0), ("w", "b", 38.5, 129.0), ("w", "none", None, 1.0)]
    found = history.moving_neighbours(spark.createDataFrame(regions, REGION), spark.createDataFrame(rows, STATION), k)
    listed = [tuple(r) for r in found.collect()]
    stations = sorted({r[0] for r in rows})
    for day in ("0001", "1989-12-31", "1990-01-01", "1990-06-01", "1991-01-01", "1995-05-15", "1999-12-31", "2000-01-01", "2024-01-01"):
        for wide, region, lat, lng in regions[:3]:
            places = [(s, e) for s in stations if (e := holding(rows, s, day))]
            wanted = sorted((math.sqrt((e[2] - lat) ** 2 + (e[3] - lng) ** 2), s) for s, e in places)[:k]
            got = sorted((r[4], r[5], r[6]) for r in listed if r[:2] == (wide, region) and r[2] <= day < r[3])
            assert [(s, pytest.approx(d)) for d, s in wanted] == [(s, d) for _, s, d in got]
            assert [n for n, _, _ in got] == list(range(1, len(got) + 1))


def test_nothing_is_nobodys_neighbour(spark):
    none = history.moving_neighbours(spark.createDataFrame([], REGION), spark.createDataFrame(moves(4), STATION))
    assert none.collect() == []
    none = history.moving_neighbours(spark.createDataFrame([("w", "r", 1.0, 1.0)], REGION), spark.createDataFrame([], STATION))
    assert none.collect() == []
