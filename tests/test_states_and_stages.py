"""Calendars, grains and fits from mergeable states; owned stage tables; bounded rank selection."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agriclime.functions.calendar import calendar_parts, tenday_key
from agriclime.operators import calendars, phenology, quantiles, regression
from agriclime.operators import rollup as ru
from agriclime.plans.interpolation import interpolate_region_climate, interpolate_region_climate_grains
from agriclime.sources import sample
from agriclime.sources.stages import StageRun
from catalog import queries as catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.registered()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9))


# ---------------------------------------------------------------- calendars


def days(spark, n=3000, seed=1):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        date = f"{draw.choice([2001, 2002])}-{draw.randint(1, 12):02d}-{draw.randint(1, 30):02d}"
        values = [draw.choice([None, float("nan"), draw.uniform(-5, 30)]) for _ in range(7)]
        out.append((draw.choice("AAAB"), draw.choice("xy"), date[: draw.choice([10, 10, 10, 7])], *values))
    names = ["tm_avg", "tm_min", "tm_max", "hm_avg", "pr_day", "ss_dura_sum", "ws_avg"]
    schema = "wide string, region string, date string, " + ", ".join(f"{c} double" for c in names)
    return tenday_key(calendar_parts(spark.createDataFrame(out, schema)))


OVERLAPPING = [
    calendars.GrowingCalendar("may", ("A", "B"), 5, 3),
    calendars.GrowingCalendar("june", ("A",), 6, 1),
    calendars.GrowingCalendar("late", ("A",), 12, 1, (phenology.PeriodRule("P2", 0, None), phenology.PeriodRule("P1", 1, 1))),
]


def one_at_a_time(daily, spec=phenology.FEATURE_SPECS):
    for c in OVERLAPPING:
        part = daily.where(F.col("wide").isin(*c.provinces))
        classified = phenology.classify_period(part, c.month, c.ten_day, c.periods())
        yield c, classified, phenology.feature_table(classified, spec)


def test_overlapping_calendars_equal_one_run_each(spark):
    daily = days(spark)
    rules = calendars.calendar_rules(spark, OVERLAPPING)
    together = calendars.feature_table_calendars(daily, rules)
    each = [rows(t.select(F.lit(c.name).alias("calendar"), "*")) for c, _, t in one_at_a_time(daily)]
    close(rows(together), sorted((r for t in each for r in t), key=str))
    classified = calendars.classify_calendars(daily.withColumn("period", F.lit("old")), rules)
    assert classified.columns.count("period") == 1
    counts = {tuple(r) for r in classified.groupBy("calendar", "period").count().collect()}
    wanted = {(c.name, *r) for c, t, _ in one_at_a_time(daily) for r in t.groupBy("period").count().collect()}
    assert counts == wanted


def test_one_statistic_and_no_rows(spark):
    daily, rules = days(spark), calendars.calendar_rules(spark, OVERLAPPING)
    spec = [phenology.FeatureSpec("tm_min", "min")]
    got = calendars.feature_table_calendars(daily, rules, spec)
    assert got.columns == ["calendar", "wide", "region", "year", *phenology.feature_columns(spec)]
    each = [rows(t.select(F.lit(c.name).alias("calendar"), "*")) for c, _, t in one_at_a_time(daily, spec)]
    close(rows(got), sorted((r for t in each for r in t), key=str))
    assert calendars.feature_table_calendars(daily.limit(0), rules).collect() == []
    assert calendars.feature_table_calendars(daily, rules.limit(0)).collect() == []


def test_calendars_share_one_scan(spark):
    text = plan(QUERIES["feature_table_calendars"](spark, FOLDER))
    assert text.count("lineitem.parquet") == 1
    # Days multiply by calendars only after they are states of ten-days.
    assert text.rindex("Generate") < text.rindex("partial_sum")


def test_a_calendar_without_rules(spark):
    with pytest.raises(ValueError, match="transplant month 3"):
        calendars.calendar_rules(spark, [calendars.GrowingCalendar("x", ("A",), 3, 1)])


# ------------------------------------------------------------------- grains


def damaged(spark):
    weather = sample.weather(spark, FOLDER)
    broken = F.when(F.col("tm_avg") % 7 == 3, F.substring("date", 1, 7)).otherwise(F.col("date"))
    nan = F.when(F.col("tm_avg") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("tm_min"))
    return calendar_parts(weather.withColumns({"date": broken, "tm_min": nan}))


@pytest.mark.parametrize("grain", list(ru.GRAINS))
def test_each_grain_equals_its_own_rollup(spark, grain):
    daily = damaged(spark)
    together = ru.spread_part(ru.rollup_grains(ru.climate_states(daily))).where(F.col("grain") == grain)
    own = ru.rollup_climate(daily, grain)
    close(rows(together.select(*own.columns)), rows(own))


def test_all_grains_read_the_weather_once(spark):
    result = QUERIES["idw_all_grains"](spark, FOLDER)
    assert "lineitem.parquet" not in plan(result)  # only the states
    assert plan(QUERIES["rollup_all_grains"](spark, FOLDER)).count("lineitem.parquet") == 1


def test_grains_of_an_empty_weather_table(spark):
    daily = calendar_parts(sample.weather(spark, FOLDER)).limit(0)
    geo, stations = sample.region_geo(spark, FOLDER), sample.stations(spark, FOLDER)
    assert interpolate_region_climate_grains(daily, geo, stations).collect() == []
    fixed = interpolate_region_climate_grains(daily, geo.limit(1), stations, (2001, 2001))
    assert fixed.count() == 12 * 6 and fixed.where("tm_avg is not null").count() == 0


# ------------------------------------------------------------ moment states

WIDE = regression.Model("wide", ("a", "b", "c"), frozenset({"b"}), "y")
NARROW = regression.Model("narrow", ("a",), y="y")


def points(spark, n=400, shift=0.0):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(shift, 1, n), rng.normal(2, 1, n), rng.normal(-1, 2, n)
    y = 3 * a - b * b + 0.5 * c + rng.normal(0, 0.1, n)
    data = [
        (["p", "q", None][i % 3], i % 4, float(a[i]), None if i % 17 == 0 else float(b[i]), float(c[i]), float(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "wide string, year int, a double, b double, c double, y double").repartition(3)


def test_models_of_different_width_in_one_call(spark):
    df = points(spark)
    both = rows(regression.ols(df, [WIDE, NARROW], ["wide"]))
    each = rows(regression.ols(df, [WIDE], ["wide"])) + rows(regression.ols(df, [NARROW], ["wide"]))
    close(both, sorted(each, key=str))
    both = rows(regression.ols_summary(df, [WIDE, NARROW]))
    each = rows(regression.ols_summary(df, [WIDE])) + rows(regression.ols_summary(df, [NARROW]))
    close(both, sorted(each, key=str))


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_old_states_and_a_new_year_equal_the_full_fit(spark, shift):
    """Also far from zero, where sums of raw products would have lost the digits."""
    df = points(spark, shift=shift)
    models = [WIDE, NARROW]
    states = [regression.moment_states(df.where(F.col("year") == y), models, ["wide"]) for y in range(4)]
    united = states[0]
    for s in states[1:]:
        united = united.unionByName(s)
    provincial = regression.merge_states(united, ["wide"])
    national = regression.merge_states(provincial)

    def fits(states, groups):
        return rows(regression.coefficients(regression.fit_states(states, models, groups), groups))

    def agree(a, b):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x[:-4] == y[:-4] and all(math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-9) for u, v in zip(x[-4:], y[-4:]))

    agree(fits(provincial, ["wide"]), rows(regression.ols(df, models, ["wide"])))
    agree(fits(national, []), rows(regression.ols(df, models)))


def test_merged_states_of_nothing(spark):
    states = regression.moment_states(points(spark).limit(0), [WIDE, NARROW], ["wide"])
    assert regression.merge_states(states).collect() == []


# ----------------------------------------------------------- rank selection


@pytest.mark.parametrize("kind", ["different", "ties", "two values"])
def test_no_task_sorts_more_than_the_bound(spark, monkeypatch, kind):
    """One group with all values different: brackets are refined until each is small."""
    draw, n = random.Random(2), 30_011
    value = {
        "different": lambda: draw.gauss(0, 1),
        "ties": lambda: float(draw.randint(0, 300)),
        "two values": lambda: draw.choice([1.0, 2.0]),
    }[kind]
    values = [value() for _ in range(n)]
    monkeypatch.setattr(quantiles, "MARGIN", 0.2)
    made, write = [], quantiles.materialize

    def recorded(df, label):
        out = write(df, label)
        if label == "quantile-values":
            made.append(out.where("v is not null").groupBy("g", "name").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "materialize", recorded)
    df = spark.createDataFrame([(None, v) for v in values] + [("small", 1.0), ("small", None)], "g string, v double")
    names = {"least": 0.0, "low": 0.1234, "middle": 0.5, "high": 0.97, "most": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", names, sorted_at_once=50).collect()}
    for name, p in names.items():
        assert math.isclose(got[None][name], float(np.quantile(values, p)), rel_tol=1e-12), name
        assert got["small"][name] == 1.0
    assert made[-1] <= 50
    if kind == "different":
        assert len(made) >= 3 and made[0] > 5000


# ------------------------------------------------------- owned stage tables


def counting(spark, seen):
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return spark.range(10).mapInArrow(run, "id long")


def settings(spark):
    return {r.key: r.value for r in spark.sql("SET").collect()}


def three_stages(spark, seen, fail):
    from agriclime.sources.tables import materialize

    first = materialize(counting(spark, seen[0]), "first")
    second = materialize(first.where("id > 3").mapInArrow(lambda b: ((seen[1].add(x.num_rows), x)[1] for x in b), "id long"), "second")
    if fail:
        raise RuntimeError("killed")
    third = materialize(second.withColumn("twice", F.col("id") * 2), "third")
    return [tuple(r) for r in third.orderBy("id").collect()]


def test_a_run_goes_on_after_the_last_complete_stage(spark, tmp_path):
    folder, seen = str(tmp_path / "run"), [spark.sparkContext.accumulator(0) for _ in range(2)]
    before = settings(spark)
    with pytest.raises(RuntimeError), StageRun(spark, folder, "v1"):
        three_stages(spark, seen, fail=True)
    assert [s.value for s in seen] == [10, 6] and os.path.isdir(folder)
    with StageRun(spark, folder, "v1") as again:
        result = three_stages(spark, seen, fail=False)
    assert result == [(i, 2 * i) for i in range(4, 10)]
    assert [s.value for s in seen] == [10, 6]
    assert again.reused == ["0000-first", "0001-second"] and again.made == ["0002-third"]
    assert not os.path.exists(folder)
    assert settings(spark) == before


def test_incomplete_or_other_stages_are_made_again(spark, tmp_path):
    folder, seen = str(tmp_path / "run"), [spark.sparkContext.accumulator(0) for _ in range(2)]
    with StageRun(spark, folder, "v1", keep=True):
        three_stages(spark, seen, fail=False)
    os.remove(f"{folder}/_manifest/0001-second.json")  # data without an entry are not complete
    with StageRun(spark, folder, "v1", keep=True) as run:
        three_stages(spark, seen, fail=False)
    assert run.reused == ["0000-first"] and run.made == ["0001-second", "0002-third"]
    with open(f"{folder}/_manifest/0000-first.json", "w") as file:
        file.write('{"version": "v1", "sch')
    with StageRun(spark, folder, "v1", keep=True) as run:
        three_stages(spark, seen, fail=False)
    assert run.reused == []
    with StageRun(spark, folder, "v2") as run:
        three_stages(spark, seen, fail=False)
    assert run.reused == [] and not os.path.exists(folder)
    with pytest.raises(ValueError):
        StageRun(spark, "")


def test_a_whole_plan_leaves_no_folder(spark, tmp_path):
    folder = str(tmp_path / "plan")
    daily = calendar_parts(sample.weather(spark, FOLDER, sparse=True))
    args = (daily, sample.region_geo(spark, FOLDER), sample.stations(spark, FOLDER), 1996, 1997)
    expected = rows(interpolate_region_climate(*args))
    with StageRun(spark, folder) as run:
        found = rows(interpolate_region_climate(*args))
        assert len(os.listdir(folder)) == len(run.made) + 1 and len(run.made) >= 3
    close(found, expected)
    assert not os.path.exists(folder)
