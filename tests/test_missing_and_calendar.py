import math

import pytest

from pyspark.sql import functions as F

from agriclime.functions import missing as ms
from agriclime.functions.calendar import calendar_parts, in_years, since_year, tenday_key
from agriclime.functions.missing import safe_int
from agriclime.operators import clean, phenology
from agriclime.operators.rollup import complete_groups, rollup_climate, valid_keys

WEATHER = (
    "station int, date string, tm_avg double, tm_min double, tm_max double, pr_day double, "
    "hm_avg double, ss_dura_sum double, rad_sum double, ws_avg double"
)


def day(station, date, tm=1.0, pr=0.0, hm=1.0, ss=1.0, rad=1.0, ws=1.0):
    return (station, date, tm, tm, tm, pr, hm, ss, rad, ws)


def test_day_boundaries(spark):
    days = [1, 10, 11, 14, 15, 20, 21, 31]
    df = spark.createDataFrame([(f"2001-05-{d:02d}",) for d in days], "date string")
    rows = {r.day: (r.ten_day, r.half) for r in calendar_parts(df).collect()}
    assert [rows[d][0] for d in days] == [1, 1, 2, 2, 2, 2, 3, 3]
    assert [rows[d][1] for d in days] == [2, 2, 2, 2, 1, 1, 1, 1]


def test_damaged_dates(spark):
    df = spark.createDataFrame([("2001-01",), (None,), ("",), ("junk-xx-yy",)], "date string")
    rows = [tuple(r) for r in tenday_key(calendar_parts(df)).collect()]
    assert rows[0] == ("2001-01", 2001, 1, None, None, None, None, None)
    assert all(r[1:] == (None,) * 7 for r in rows[1:])
    assert clean.date_complete(df).count() == 1


def test_year_filter_matches_integer_comparison(spark):
    dates = ["2000-12-31", "2001-01-01", "2021-05-05", "abcd-01-01", "", None, "2001"]
    df = calendar_parts(spark.createDataFrame([(d,) for d in dates], "date string"))
    kept = {r.date for r in since_year(df, 2001).collect()}
    assert kept == {"2001-01-01", "2021-05-05", "2001"}
    for first, last in ((2000, 2001), (2001, 2001), (1, 2500), (2001, 9999), (2005, 2004)):
        want = {r.date for r in df.collect() if r.year and first <= r.year <= last}
        assert {r.date for r in in_years(df, first, last).collect()} == want


@pytest.mark.parametrize("first", [999, 1998])
def test_year_filter_does_not_look_at_the_date_text(spark, first):
    df = spark.createDataFrame([(None, 2001), ("15-03-2001", 2001), ("1990-01-01", 900)], "date string, year int")
    assert {r.year for r in since_year(df, first).collect()} == {2001}
    assert since_year(df, first).count() == in_years(df, first, 2001).count() == 2


def test_years_of_calendar_parts_equal_the_filter(spark):
    dates = ["1997-12-31", "1998-01-01", " 199", "+200", "2001", "abcd", "", None, "19980101", "9998-01-01"]
    raw = spark.createDataFrame([(d,) for d in dates], "date string")
    for first, last in ((1998, None), (1998, 2001), (1, None), (1998, 9999)):
        plain = calendar_parts(raw)
        plain = since_year(plain, first) if last is None else in_years(plain, first, last)
        assert sorted(map(str, calendar_parts(raw, years=(first, last)).collect())) == sorted(map(str, plain.collect()))


def test_safe_int_takes_no_java_suffix(spark):
    texts = ["90", "90.7", " 90 ", "+9e1", "90d", "90f", "90D", "0x5A", "NaN", "Infinity", "", None, ".", "-.5"]
    df = spark.createDataFrame([(t,) for t in texts], "station string")
    got = [r[0] for r in df.select(safe_int("station")).collect()]
    assert got == [90, 90, 90, 90] + [None] * 9 + [0]


def test_mean_skips_null_and_nan(spark):
    nan = float("nan")
    rows = [
        day(1, "2001-05-01", 1.0, None), day(1, "2001-05-02", nan, None),
        day(1, "2001-05-03", None, None), day(2, "2001-05-01", nan, nan),
        day(2, "2001-05-02", None, None, rad=nan),
    ]
    daily = calendar_parts(spark.createDataFrame(rows, WEATHER))
    out = {r.station: r for r in rollup_climate(daily).collect()}
    assert out[1].tm_avg == 1.0 and out[1].pr_sum == 0.0
    assert out[2].tm_avg is None and out[2].pr_sum == 0.0


def test_incomplete_groups_are_dropped(spark):
    nan = float("nan")
    rows = [
        day(1, "2001-05-01"), day(2, "2001-05-01", rad=nan), day(3, "2001-05-01", hm=None),
        day(4, "2001-05-01", ss=None), day(5, "2001-05-01", tm=None), day(6, "bad"),
    ]
    rolled = rollup_climate(calendar_parts(spark.createDataFrame(rows, WEATHER)))
    assert {r.station for r in complete_groups(rolled).collect()} == {1, 5, 6}
    assert {r.station for r in valid_keys(complete_groups(rolled)).collect()} == {1, 5}


def test_station_cast(spark):
    df = spark.createDataFrame([("90",), ("junk",), ("12.7",), (None,), ("1e99",)], "station string")
    assert [r.station for r in clean.safe_station(df).collect()] == [90, 12]


def test_degree_sum_is_clipped_after_the_sum(spark):
    df = spark.createDataFrame(
        [("a", 5.0), ("a", 5.0), ("b", 12.0), ("b", 13.0), ("c", 5.0), ("c", 20.0), ("d", None)],
        "g string, x double",
    )
    out = dict(df.groupBy("g").agg(ms.growing_degree_sum("x")).collect())
    assert out == {"a": 0.0, "b": 5.0, "c": 5.0, "d": 0.0}


def test_regex_exclusion_keeps_missing(spark):
    df = spark.createDataFrame([("소계",), ("논산시",), (None,)], "region string")
    kept = [r.region for r in clean.exclude_matching(df, "region", "소계").collect()]
    assert kept == ["논산시", None]


def test_fill_precip(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.5,)], "pr_day double")
    assert [r.pr_day for r in clean.fill_precip(df).collect()] == [0.0, 0.0, 2.5]


def test_projection_by_position(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert clean.project_at(df, (3, 1, 3)).columns == ["c", "a"]
    assert clean.drop_at(df, (2,)).columns == ["a", "c"]
    assert clean.placeholders(df, ["st1"], "int").first().st1 is None


def test_station_history(spark):
    stations = spark.createDataFrame(
        [(1, "1980-01-01", 1.0, 1.0, "w", "old", "r"), (1, "1999-01-01", 2.0, 2.0, "w", "new", "r"),
         (2, None, 3.0, 3.0, "w", "only", "r")],
        "station int, date_start string, latitude double, longitude double, wide string, "
        "station_name string, region string",
    )
    daily = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "station int, tm_avg double")
    assert clean.station_join(daily, stations).count() == 4
    one = {r.station: r.station_name for r in
           clean.station_join(daily, stations, one_per_station=True).collect()}
    assert one == {1: "new", 2: "only", 3: None}


def test_two_coordinates_for_a_region_raise(spark):
    import pytest

    regions = spark.createDataFrame([("w", "a"), ("w", "b")], "wide string, region string")
    geo = "wide string, region string, lat double, lng double"
    good = spark.createDataFrame([("w", "a", 1.0, 2.0)], geo)
    rows = {r.region: r.lat for r in clean.region_coordinates(regions, good).collect()}
    assert rows == {"a": 1.0, "b": None}
    twice = spark.createDataFrame([("w", "a", 1.0, 2.0), ("w", "a", 3.0, 4.0)], geo)
    with pytest.raises(Exception, match="more than one coordinate row"):
        clean.region_coordinates(regions, twice).collect()


def _tendays(spark):
    return spark.range(1, 37).select(F.col("id").cast("int").alias("tenday_no"))


def test_each_tenday_has_one_period_at_most(spark):
    for month, ten_day in ((5, 1), (5, 3), (6, 1), (6, 2), (7, 1)):
        out = phenology.classify_period(_tendays(spark), month, ten_day).collect()
        start = (month - 1) * 3 + ten_day
        for row in out:
            k = row.tenday_no - start
            hits = [r.period for r in phenology.PERIOD_RULES[month] if r.lo <= k <= r.hi]
            assert hits == [row.period]
        assert len(out) == len({r.tenday_no for r in out}) == 11


def test_literal_may_rule_never_ends(spark):
    out = phenology.classify_period(_tendays(spark), 5, 3, literal_month5=True).collect()
    assert {r.tenday_no: r.period for r in out} == {
        **{15: "P1"}, **{n: "P2" for n in range(16, 21)}, **{n: "P3" for n in range(21, 37)}
    }


def test_unknown_month_needs_rules(spark):
    import pytest

    with pytest.raises(ValueError):
        phenology.classify_period(_tendays(spark), 4, 1)
    rules = (phenology.PeriodRule("P1", -1, 0), phenology.PeriodRule("P2", 0, 2))
    out = phenology.classify_period(_tendays(spark), 4, 1, rules).collect()
    assert {r.tenday_no: r.period for r in out} == {9: "P1", 10: "P1", 11: "P2", 12: "P2"}


def test_rules_as_rows_agree_with_the_lookup(spark):
    daily = _tendays(spark).withColumn("wide", F.explode(F.array(F.lit("x"), F.lit("y"))))
    rows = [("x", 5, 3, r.period, r.lo, r.hi) for r in phenology.MONTH5_LITERAL]
    rows += [("y", 7, 1, r.period, r.lo, r.hi) for r in phenology.PERIOD_RULES[7]]
    rules = spark.createDataFrame(
        rows, "wide string, month int, ten_day int, period string, lo int, hi int"
    )
    by_rows = {tuple(r) for r in phenology.classify_period_by_group(daily, rules)
               .select("wide", "tenday_no", "period").collect()}
    direct = set()
    for wide, month, ten_day, literal in (("x", 5, 3, True), ("y", 7, 1, False)):
        part = phenology.classify_period(daily.where(F.col("wide") == wide), month, ten_day,
                                         literal_month5=literal)
        direct |= {tuple(r) for r in part.select("wide", "tenday_no", "period").collect()}
    assert by_rows == direct


def test_absent_and_all_missing_periods(spark):
    schema = "wide string, region string, year int, period string, tm_avg double, pr_day double"
    df = spark.createDataFrame(
        [("w", "r", 2001, "P1", 12.0, None), ("w", "r", 2001, "P1", None, 1.5),
         ("w", "r", 2001, "P2", None, None)],
        schema,
    )
    specs = [phenology.FeatureSpec("tm_avg", "mean"), phenology.FeatureSpec("pr_day", "sum"),
             phenology.FeatureSpec("tm_avg", "gdd10c")]
    row = phenology.feature_table(df, specs).first().asDict()
    assert (row["tm_avg_P1"], row["pr_day_P1"], row["gdd10c_P1"]) == (12.0, 1.5, 2.0)
    assert (row["tm_avg_P2"], row["pr_day_P2"], row["gdd10c_P2"]) == (None, 0.0, 0.0)
    for name in ("tm_avg", "pr_day", "gdd10c"):
        assert [row[f"{name}_P{n}"] for n in (3, 4, 5)] == [None] * 3


def test_each_statistic_alone_equals_the_table(spark):
    schema = "wide string, region string, year int, period string, v double"
    df = spark.createDataFrame(
        [("w", "r", 2001 + i % 3, f"P{1 + i % 5}", float(i * 7 % 13)) for i in range(60)], schema
    )
    for stat in phenology.STATISTICS:
        wide = phenology.period_stat(df, "v", stat)
        name = "gdd10c" if stat == "gdd10c" else "v"
        long = {
            (r.year, r.period): r.s
            for r in df.groupBy("year", "period").agg(phenology.STATISTICS[stat]("v").alias("s"))
            .collect()
        }
        for row in wide.collect():
            for p in phenology.PERIODS:
                got, want = row[f"{name}_{p}"], long.get((row.year, p))
                assert got == want or math.isclose(got, want)


def test_subtotals_and_years_are_left_out(spark):
    features = spark.createDataFrame(
        [("w", "a", 2020, 1.0), ("w", "소계", 2020, 1.0), ("w", None, 2020, 1.0),
         ("w", "a", 2021, 1.0), ("w", "a", None, 1.0)],
        "wide string, region string, year int, tm_avg_P1 double",
    )
    yields = spark.createDataFrame(
        [("w", "a", 2020, 500.0)], "wide string, region string, year int, prod_10a_kg double"
    )
    out = phenology.feature_yield(features, yields)
    assert out.columns == ["wide", "region", "year", "prod_10a_kg", "tm_avg_P1"]
    assert {(r.region, r.prod_10a_kg) for r in out.collect()} == {("a", 500.0), (None, None)}


def test_row_operators_accept_a_stream(spark, tmp_path):
    rows = [day(1, "2001-05-21", pr=None), day(2, "2001")]
    spark.createDataFrame(rows, WEATHER).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(WEATHER).parquet(str(tmp_path / "in"))
    df = tenday_key(clean.date_complete(clean.safe_station(clean.fill_precip(calendar_parts(stream)))))
    df = phenology.classify_period(df, 5, 3)
    query = (df.writeStream.format("memory").queryName("classified")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert [(r.station, r.period, r.pr_day) for r in spark.table("classified").collect()] == [
        (1, "P1", 0.0)
    ]
