"""A kept interpolation brought up to date equals one made of all rows."""

import math
import os

import pytest
from pyspark.sql import functions as F

from agriclime.functions.calendar import calendar_parts
from agriclime.plans.incremental import add_reports, create_store, read_climate
from agriclime.plans.interpolation import interpolate_region_climate_grains
from agriclime.sources import sample

FOLDER = "/root/testdata/sf0.001"
YEARS = (1994, 1996)


@pytest.fixture(scope="module")
def inputs(spark):
    daily = calendar_parts(sample.weather(spark, FOLDER, sparse=True))
    return daily, sample.region_geo(spark, FOLDER).limit(12), sample.stations(spark, FOLDER)


def files_of(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows(df):
    return {tuple(r)[:6]: tuple(r)[6:] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[k], b[k])), k


def test_late_reports_equal_a_full_run(spark, tmp_path, inputs):
    daily, regions, stations = inputs
    folder = str(tmp_path / "store")
    late = (F.col("station") == 3) & (F.col("year") == 1995) & (F.col("month") < 4)
    create_store(folder, daily.where(~late), regions, stations, *YEARS)
    before, settings = files_of(folder), {r.key: r.value for r in spark.sql("SET").collect()}
    old = rows(read_climate(spark, folder))
    touched = {tuple(r) for r in add_reports(folder, daily.where(late), "late").collect()}
    # Only regions with that station, only its months.
    near = spark.read.parquet(f"{folder}/neighbours").where("station = 3")
    regions_of = {tuple(r) for r in near.select("wide", "region").collect()}
    months = {r[0] for r in daily.where(late).select("month").distinct().collect()}
    assert touched == {(*r, 1995, m) for r in regions_of for m in months} and touched
    # Only the year's folder is written again; the delivery adds states of its own.
    gone, new = before - files_of(folder), files_of(folder) - before
    assert gone and all("/climate/year=1995/" in f for f in gone)
    assert all("/climate/year=1995/" in f or "/states/delivery=late/year=1995/" in f for f in new)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == settings

    full = str(tmp_path / "full")
    create_store(full, daily, regions, stations, *YEARS)
    now = rows(read_climate(spark, folder))
    same(now, rows(read_climate(spark, full)))
    changed = {k for k in now if now[k] != old[k]}
    assert changed and {(*k[:2], k[3], k[4]) for k in changed} <= touched

    # Again: a delivery of the same name is replaced, not added.
    add_reports(folder, daily.where(late), "late")
    same(rows(read_climate(spark, folder)), now)


def test_a_store_equals_the_plan(spark, tmp_path, inputs):
    daily, regions, stations = inputs
    folder = str(tmp_path / "store")
    create_store(folder, daily, regions, stations, *YEARS)
    plan = interpolate_region_climate_grains(daily, regions, stations, YEARS)
    part = F.coalesce("ten_day", "half", F.lit(0)).alias("part")
    measures = plan.columns[-6:]
    same(rows(read_climate(spark, folder)), rows(plan.select("wide", "region", "grain", "year", "month", part, *measures)))


def test_reports_that_touch_nothing(spark, tmp_path, inputs):
    daily, regions, stations = inputs
    folder = str(tmp_path / "store")
    create_store(folder, daily, regions, stations, *YEARS)
    before = {f for f in files_of(folder) if "/climate/" in f}
    for odd in (daily.limit(0), daily.where("year = 1999"), daily.withColumn("station", F.lit(10**6))):
        assert add_reports(folder, odd, "odd").collect() == []
    assert {f for f in files_of(folder) if "/climate/" in f} == before
    with pytest.raises(ValueError):
        add_reports(folder, daily, "first")
