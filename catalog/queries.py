"""Registered queries: each applies one operator to the whole sample tables.

Doubles are rounded to six places at the very end, so that sums taken in a
different order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.functions.calendar import calendar_parts, since_year, tenday_key
from agriclime.operators import calendars, clean, coverage, edges, history, interpolate, phenology, regression
from agriclime.operators import rollup as ru
from agriclime.operators import spatial, yields as yl
from agriclime.plans.features import (
    calendar_features,
    calendar_features_with_yield,
    period_features,
    period_features_with_yield,
    region_daily,
)
from agriclime.plans.incremental import add_reports, create_store, read_climate
from agriclime.plans.interpolation import (
    interpolate_region_climate,
    interpolate_region_climate_grains,
    neighbour_table,
)
from agriclime.plans.regression import ALL_MODELS, regression_tables
from agriclime.sources import files, sample
from agriclime.sources.tables import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]

FEATURE_YEAR, TRANSPLANT_MONTH, TRANSPLANT_TENDAY = 1996, 5, 3
SOME_PROVINCES = ("AMERICA", "ASIA", "EUROPE")
NEAR_ROW, FAR_ROW = 700, 12_345


def rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in doubles})


def _daily(spark, d, sparse=False):
    return calendar_parts(sample.weather(spark, d, sparse))


def _rollup(spark, d, grain, sparse=False):
    return ru.rollup_climate(_daily(spark, d, sparse), grain)


def _complete(spark, d, grain):
    return ru.complete_groups(_rollup(spark, d, grain))


# Weather with damaged keys, as the raw files have them.
def _damaged(spark, d):
    w = sample.weather(spark, d)
    station, line = F.col("station").cast("string"), F.pmod(F.col("tm_avg"), F.lit(7.0))
    return w.withColumns(
        {
            "station": F.when(line == 0, F.lit("junk"))
            .when(line == 1, F.concat(station, F.lit(".7")))
            .when(line == 2, F.lit(None).cast("string"))
            .when(line == 4, F.concat(station, F.lit("d")))
            .otherwise(station),
            "date": F.when(line == 3, F.substring("date", 1, 7)).otherwise(F.col("date")),
        }
    )


def _calendar(spark, d):
    return calendar_parts(_damaged(spark, d)).select(
        "station", "date", "year", "month", "day", "half", "ten_day"
    )


def _tenday_key(spark, d):
    return tenday_key(calendar_parts(_damaged(spark, d))).select(
        "station", "date", "month", "ten_day", "mon_third", "tenday_no"
    )


def _projection(spark, d):
    return clean.project(_daily(spark, d), clean.ROLLUP_COLUMNS)


def _projection_at(spark, d):
    # The weather table plus calendar parts; position 3 is asked for twice.
    return clean.project_at(_daily(spark, d), (1, 2, 3, 11, 12, 13, 14, 15, 3, 4, 5, 6, 10, 7, 8, 9))


def _drop_at(spark, d):
    return clean.drop_at(sample.station_history(spark, d), (5,))


def _rename(spark, d):
    foreign = ("province", "county", "jahr", "area", "per_10a", "tons")
    return files.yield_names(sample.yields(spark, d).toDF(*foreign))


def _placeholders(spark, d):
    return clean.placeholders(sample.stations(spark, d), ["tm_avg", "pr_sum"])


def _year_start(spark, d):
    return files.with_year_start(sample.station_history(spark, d)).select(
        "station", "date_start", "year_start"
    )


def _rollup_query(grain):
    return lambda spark, d: _rollup(spark, d, grain)


def _complete_query(grain):
    return lambda spark, d: _complete(spark, d, grain)


def _valid_keys(spark, d):
    daily = calendar_parts(_damaged(spark, d))
    return ru.valid_keys(ru.complete_groups(ru.rollup_climate(daily, "tenday")), "tenday")


# Rows are dropped by position from a stored rollup: its keys are read again to find
# the position, the weather is not.
def _trim(grain):
    return lambda spark, d: edges.trim_edge_groups(
        materialize(_rollup(spark, d, grain), "rollup"), ru.group_keys(grain)
    )


def _drop_row(grain, n):
    return lambda spark, d: edges.drop_row_at(
        materialize(_rollup(spark, d, grain), "rollup"), ru.group_keys(grain), n
    )


# The rows that the analysis drops by hand, both edges and one in the middle, at once.
DROPPED_ROWS = (1, 2, 3, 4, 5, FAR_ROW, -1)


def _drop_rows(spark, d):
    rolled = materialize(_rollup(spark, d, "tenday"), "rollup")
    return edges.drop_rows_at(rolled, ru.group_keys("tenday"), DROPPED_ROWS)


def _station_tally(spark, d):
    return ru.station_tally(sample.weather(spark, d))


def _coverage_long(spark, d):
    return coverage.coverage_long(_complete(spark, d, "month"), ru.time_keys("month"))


def _coverage_matrix(grain):
    return lambda spark, d: coverage.coverage_tiles(
        _complete(spark, d, grain), ru.time_keys(grain)
    )


def _station_count(grain):
    return lambda spark, d: coverage.station_count(
        _complete(spark, d, grain), ru.time_keys(grain)
    )


def _wind_profile(spark, d):
    w = sample.weather(spark, d).withColumn("ws_max", F.col("ws_avg") + F.col("ss_dura_sum"))
    w = w.withColumn("ws_avg", F.when(F.col("hm_avg").isNotNull(), F.col("ws_avg")))
    return coverage.wind_profile(w, ["ws_max", "ws_avg"])


def _all_regions(spark, d):
    """The regions with a station, and as many that have no coordinates on file."""
    known = sample.region_list(spark, d)
    return known.unionByName(known.withColumn("region", F.concat("region", F.lit("_NEW"))))


def _region_geo_join(spark, d):
    return clean.region_coordinates(_all_regions(spark, d), sample.region_geo(spark, d))


def _neighbours(spark, d):
    return spatial.nearest_stations(sample.region_geo(spark, d), sample.stations(spark, d))


def _knn_many(spark, d):
    return spatial.nearest_stations(sample.sites(spark, d), sample.stations(spark, d))


def _knn_wide(spark, d):
    return spatial.neighbours_wide(_neighbours(spark, d))


def _years(spark, d):
    """First and last year of the weather."""
    year = F.col("year")
    years = calendar_parts(sample.weather(spark, d)).agg(F.min(year).alias("a"), F.max(year).alias("b"))
    return tuple(years.first())


def _region_grid(spark, d):
    return interpolate.region_grid(sample.region_list(spark, d), *_years(spark, d))


def _nearest_reporting(spark, d):
    neighbours = neighbour_table(sample.region_geo(spark, d), sample.stations(spark, d))
    wanted = interpolate.weather_of_neighbours(_daily(spark, d, sparse=True), neighbours)
    reported = ru.complete_groups(ru.rollup_climate(wanted))
    chosen = interpolate.nearest_reporting(neighbours, reported)
    return chosen.select("wide", "region", "year", "month", "place", "station", "dist", "tm_avg")


def _idw(grain, pairing="aligned"):
    def query(spark, d):
        return interpolate_region_climate(
            _daily(spark, d, sparse=True), sample.region_geo(spark, d),
            sample.stations(spark, d), *_years(spark, d), grain, pairing=pairing,
        )

    return query


def _rollup_all_grains(spark, d):
    return ru.spread_part(ru.rollup_grains(ru.climate_states(_daily(spark, d))))


def _idw_all_grains(spark, d):
    return interpolate_region_climate_grains(
        _daily(spark, d, sparse=True), sample.region_geo(spark, d), sample.stations(spark, d)
    )


def _idw_late_reports(spark, d):
    """A kept interpolation, made without one ninth of the stations' spring of one year."""
    daily, folder = _daily(spark, d, sparse=True), new_path(spark, "climate-store")
    late = (F.col("station") % 9 == 4) & (F.col("year") == 1996) & F.col("month").between(3, 5)
    late = F.coalesce(late, F.lit(False))
    create_store(folder, daily.where(~late), sample.region_geo(spark, d), sample.stations(spark, d), *_years(spark, d))
    add_reports(folder, daily.where(late), "late")
    return ru.spread_part(read_climate(spark, folder))


def _idw_history(spark, d):
    return interpolate_region_climate(
        _daily(spark, d, sparse=True), sample.region_geo(spark, d),
        sample.station_history(spark, d), *_years(spark, d),
    )


def _idw_moved(spark, d):
    return interpolate_region_climate(
        _daily(spark, d, sparse=True), sample.region_geo(spark, d), sample.station_moves(spark, d),
        *_years(spark, d), moves=True,
    )


def _moving_neighbours(spark, d):
    return history.moving_neighbours(sample.region_geo(spark, d), sample.station_moves(spark, d))


def _station_as_of(spark, d):
    joined = history.station_join_as_of(sample.weather(spark, d), sample.station_moves(spark, d))
    return joined.select("station", "date", "tm_avg", "wide", "station_name", "region")


def _idw_unlocated(spark, d):
    return interpolate_region_climate(
        _daily(spark, d, sparse=True), _all_regions(spark, d), sample.stations(spark, d),
        *_years(spark, d), geo=sample.region_geo(spark, d),
    )


def _csv_roundtrip(spark, d):
    path = new_path(spark, "region-month-csv")
    region_month = _idw("month")(spark, d)
    files.write_csv(region_month, path, ["wide", "region", "year", "month"])
    types = {f.name: f.dataType.simpleString() for f in region_month.schema}
    return files.read_typed_csv(spark, path, types)


def _mixed_files(spark, d):
    """Station files of two header orders in one folder, some with damaged rows, read back."""
    path = new_path(spark, "station-files")
    columns = ["station", "latitude", "wide", "station_name", "region"]
    stations = sample.stations(spark, d).select(*columns)
    damaged = F.when(F.col("station") % 7 == 3, F.lit("unknown")).otherwise(F.format_number("latitude", 4))
    stations = materialize(stations.withColumn("latitude", damaged), "stations")
    for half, order in ((0, columns), (1, columns[::-1])):
        part = stations.where(F.col("station") % 2 == half).select(*order)
        part.write.options(header=True, **files.QUOTING).mode("append").csv(path)
    return files.read_csv_files(spark, path, {c: files.STATION_TYPES[c] for c in columns})


def _csv_mixed_headers(spark, d):
    return _mixed_files(spark, d)[0]


def _csv_damaged_rows(spark, d):
    fields = F.split("line", ",")
    number = F.coalesce(fields[0].try_cast("int"), fields[4].try_cast("int"))
    return _mixed_files(spark, d)[1].select(number.alias("station"), F.size(fields).alias("fields"), "line")


def _parquet_stage(spark, d):
    joined = clean.station_join(
        clean.date_complete(clean.safe_station(clean.fill_precip(_daily(spark, d)))),
        sample.stations(spark, d),
    )
    return materialize(joined.drop("rad_sum"), "region-daily", partition_by=["year"])


def _fill_precip(spark, d):
    return clean.fill_precip(sample.weather(spark, d)).select("station", "date", "pr_day")


def _safe_station(spark, d):
    return clean.safe_station(_damaged(spark, d)).select("station", "date", "tm_avg")


def _station_join(spark, d):
    return clean.station_join(
        clean.safe_station(_damaged(spark, d)), sample.stations(spark, d)
    ).select("station", "date", "tm_avg", "wide", "station_name", "region")


def _history_join(latest):
    return lambda spark, d: clean.station_join(
        sample.weather(spark, d), sample.station_history(spark, d), one_per_station=latest
    ).select("station", "date", "tm_avg", "wide", "station_name", "region")


def _latest_station(spark, d):
    return clean.latest_station(sample.station_history(spark, d))


def _date_length(spark, d):
    return clean.date_complete(_damaged(spark, d)).select("station", "date", "tm_avg")


def _province_in(spark, d):
    return clean.station_join(
        sample.weather(spark, d), sample.stations(spark, d), provinces=SOME_PROVINCES
    ).select("station", "date", "wide", "tm_avg")


def _equal_filter(spark, d):
    joined = clean.station_join(_daily(spark, d), sample.stations(spark, d))
    return joined.where((F.col("wide") == "ASIA") & (F.col("month") == 5)).select(
        "station", "date", "wide", "tm_avg"
    )


def _since_year(spark, d):
    return since_year(_daily(spark, d), 1998).select("station", "date", "year", "tm_avg")


def _since_year_damaged(spark, d):
    """Years count, not date texts: some rows have lost theirs."""
    daily = calendar_parts(_damaged(spark, d))
    lost = F.pmod(F.col("tm_avg"), F.lit(5.0)) == 0
    daily = daily.withColumn("date", F.when(~lost, F.col("date")))
    return since_year(daily, 1998).select("station", "date", "year", "tm_avg")


def _region_day_mean(spark, d):
    return clean.region_day_mean(
        clean.station_join(sample.weather(spark, d), sample.stations(spark, d))
    )


# Names given to the sample regions in the yield queries, by number.
SAMPLE_NAMES = (
    "충청남도", "경기도", "강원도", "제주도", "서울특별시", "부산광역시", "전라북도", None,
)


def _korean_yields(spark, d):
    number = F.substring_index("region", "_", -1).cast("int")
    name = F.get(F.array(*[F.lit(n) for n in SAMPLE_NAMES]), F.pmod(number, F.lit(8)))
    subtotal = F.when(F.pmod(number, F.lit(9)) == 0, F.lit("소계")).otherwise(F.col("region"))
    return sample.yields(spark, d).withColumns({"wide": name, "region": subtotal})


def _regex_exclude(spark, d):
    kept = clean.exclude_matching(_korean_yields(spark, d), "wide", yl.METROPOLITAN_PATTERN)
    return clean.exclude_matching(kept, "region", clean.SUBTOTAL_PATTERN)


def _province_abbrev(spark, d):
    return _korean_yields(spark, d).withColumn("short", yl.province_abbrev())


def _yield_union(spark, d):
    whole = materialize(sample.yields(spark, d), "yields")
    return yl.yield_union(*sample.split_by_year(whole))


def _yield_trend(spark, d):
    return yl.yield_trend(sample.yields(spark, d))


TREND_MODEL = regression.Model("trend", ("year",))


def _yield_trend_ols(spark, d):
    return regression.ols(sample.yields(spark, d), [TREND_MODEL])


def _yield_trend_summary(spark, d):
    return regression_tables(sample.yields(spark, d), [TREND_MODEL])["summary"]


def _yield_detrend(spark, d):
    y = materialize(sample.yields(spark, d), "yields")
    return yl.detrend(y, yl.yield_trend(y))


def _normalized_yields(spark, d):
    whole = materialize(_korean_yields(spark, d), "yields")
    return yl.normalized_yields(sample.split_by_year(whole))


def _region_daily(spark, d):
    places = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    return region_daily(sample.weather(spark, d), sample.stations(spark, d), places)


def _tenday_tally(spark, d):
    return ru.tenday_tally(tenday_key(_daily(spark, d)))


def _classify(month, literal=False):
    def query(spark, d):
        daily = tenday_key(_daily(spark, d))
        return phenology.classify_period(daily, month, 3, literal_month5=literal).select(
            "station", "date", "tenday_no", "period"
        )

    return query


# Per province its own transplant ten-day and periods.
def _rules(spark, d):
    names = sample.region_geo(spark, d).select("wide").distinct()
    early = F.col("wide").isin("ASIA", "EUROPE")
    spans = F.array(
        *[
            F.struct(F.lit(p).alias("period"), F.lit(a).alias("lo"), F.lit(b).alias("hi"))
            for p, a, b in (("P1", 0, 0), ("P2", 1, 5), ("P3", 6, 8), ("P4", 9, 10),
                            ("P5", 11, None))
        ]
    )
    return names.select(
        "wide",
        F.when(early, 5).otherwise(6).alias("month"),
        F.when(early, 2).otherwise(1).alias("ten_day"),
        F.explode(spans).alias("span"),
    ).select("wide", "month", "ten_day", "span.*")


def _classify_by_group(spark, d):
    return phenology.classify_period_by_group(_region_daily(spark, d), _rules(spark, d)).select(
        "station", "date", "wide", "tenday_no", "period"
    )


# The six data sets of the analysis with the sample's provinces: two transplant ten-days for
# each of three groups, so that every row belongs to up to two calendars.
SAMPLE_GROUPS = {
    "south": ("AMERICA", "ASIA"),
    "middle": ("EUROPE", "AFRICA"),
    "mountain": ("MIDDLE EAST",),
}


def _sample_calendars():
    return [
        replace(c, provinces=SAMPLE_GROUPS[c.name.partition("_")[0]]) for c in calendars.RICE_CALENDARS
    ]


def _classify_calendars(spark, d):
    rules = calendars.calendar_rules(spark, _sample_calendars())
    return calendars.classify_calendars(_region_daily(spark, d), rules).select(
        "station", "date", "wide", "tenday_no", "calendar", "period"
    )


def _feature_table_calendars(spark, d):
    rules = calendars.calendar_rules(spark, _sample_calendars())
    return calendar_features(_region_daily(spark, d), rules, FEATURE_YEAR)


def _feature_yield_calendars(spark, d):
    rules = calendars.calendar_rules(spark, _sample_calendars())
    return calendar_features_with_yield(
        _region_daily(spark, d), sample.yields(spark, d), rules, FEATURE_YEAR, exclude_year=2001
    )


def _classified(spark, d):
    recent = since_year(_region_daily(spark, d), FEATURE_YEAR)
    return phenology.classify_period(recent, TRANSPLANT_MONTH, TRANSPLANT_TENDAY)


def _period(var, stat):
    return lambda spark, d: phenology.period_stat(_classified(spark, d), var, stat)


def _period_literal(spark, d):
    return period_features(
        _region_daily(spark, d), FEATURE_YEAR, TRANSPLANT_MONTH, TRANSPLANT_TENDAY,
        literal_month5=True,
    )


def _period_m7(spark, d):
    return period_features(_region_daily(spark, d), FEATURE_YEAR, 7, 1)


def _feature_table(spark, d):
    return phenology.feature_table(_classified(spark, d))


def _feature_table_history(spark, d):
    places = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    daily = region_daily(
        sample.weather(spark, d), sample.station_history(spark, d), places, years=(FEATURE_YEAR, None)
    )
    return period_features(daily, FEATURE_YEAR, TRANSPLANT_MONTH, TRANSPLANT_TENDAY)


def _feature_yield(spark, d, exclude_year=2001):
    return period_features_with_yield(
        _region_daily(spark, d), sample.yields(spark, d), FEATURE_YEAR, TRANSPLANT_MONTH,
        TRANSPLANT_TENDAY, exclude_year=exclude_year,
    )


def _feature_yield_wide(spark, d):
    return period_features_with_yield(
        _region_daily(spark, d), sample.yields(spark, d), FEATURE_YEAR, TRANSPLANT_MONTH,
        TRANSPLANT_TENDAY, keys=("wide", "year"), exclude_year=2001,
    )


def _observations(spark, d):
    return _feature_yield(spark, d, exclude_year=2021)


# For operators that pass over the feature table more than once.
def _stored_observations(spark, d):
    return materialize(_observations(spark, d), "features")


def _ols(model):
    return lambda spark, d: regression.ols(_observations(spark, d), [model])


def _vif(model):
    return lambda spark, d: regression.vif(_observations(spark, d), [model])


def _ols_all(spark, d):
    return regression.ols(_observations(spark, d), ALL_MODELS)


def _ols_summary(spark, d):
    return regression_tables(_observations(spark, d))["summary"]


def _ols_by_province(spark, d):
    return regression.ols(_observations(spark, d), [regression.LINEAR_MODELS[0]], ["wide"])


def _ols_summary_by_province(spark, d):
    return regression_tables(_observations(spark, d), groups=["wide"])["summary"]


def _vif_by_province(spark, d):
    return regression_tables(_observations(spark, d), groups=["wide"])["vif"]


def _ols_merged_states(spark, d):
    """All national fits from stored states per province: the early years' and the others'."""
    seen = _stored_observations(spark, d)
    early, late = (
        regression.moment_states(seen.where(years), ALL_MODELS, ["wide"])
        for years in (F.col("year") < 1999, F.col("year") >= 1999)
    )
    merged = regression.merge_states(early.unionByName(late))
    return regression.coefficients(regression.fit_states(merged, ALL_MODELS))


def _ols_mixed_widths(spark, d):
    return regression.ols(_observations(spark, d), [TREND_MODEL, regression.LINEAR_MODELS[0]])


def _trend_points(spark, d):
    return regression.trend_points(_stored_observations(spark, d), "tm_avg_P1")


def registered() -> dict[str, Query]:
    out: dict[str, Query] = {
        "calendar_parts": _calendar,
        "tenday_key": _tenday_key,
        "projection": _projection,
        "projection_at": _projection_at,
        "drop_column": _drop_at,
        "rename_columns": _rename,
        "placeholder_columns": _placeholders,
        "station_year_start": _year_start,
        "valid_keys": _valid_keys,
        "station_tally": _station_tally,
        "tenday_tally": _tenday_tally,
        "coverage_long": _coverage_long,
        "coverage_matrix": _coverage_matrix("month"),
        "coverage_matrix_tenday": _coverage_matrix("tenday"),
        "coverage_matrix_half": _coverage_matrix("half"),
        "station_count": _station_count("month"),
        "coverage_tenday": _station_count("tenday"),
        "coverage_half": _station_count("half"),
        "wind_profile": _wind_profile,
        "region_geo_join": _region_geo_join,
        "knn_long": _neighbours,
        "knn_many_regions": _knn_many,
        "knn_wide": _knn_wide,
        "region_grid": _region_grid,
        "nearest_reporting": _nearest_reporting,
        "idw_month": _idw("month"),
        "idw_month_history": _idw_history,
        "idw_late_reports": _idw_late_reports,
        "idw_month_moved_station": _idw_moved,
        "station_join_as_of": _station_as_of,
        "idw_unlocated_region": _idw_unlocated,
        "since_year_damaged": _since_year_damaged,
        "feature_table_history": _feature_table_history,
        "idw_tenday": _idw("tenday"),
        "idw_half": _idw("half"),
        "idw_station_order": _idw("month", "station_order"),
        "csv_roundtrip": _csv_roundtrip,
        "csv_mixed_headers": _csv_mixed_headers,
        "csv_damaged_rows": _csv_damaged_rows,
        "parquet_stage": _parquet_stage,
        "fill_precip": _fill_precip,
        "safe_station": _safe_station,
        "station_join": _station_join,
        "station_history_join": _history_join(False),
        "station_latest_join": _history_join(True),
        "latest_station": _latest_station,
        "date_length_filter": _date_length,
        "province_in": _province_in,
        "equal_filter": _equal_filter,
        "since_year": _since_year,
        "regex_exclude": _regex_exclude,
        "region_day_mean": _region_day_mean,
        "yield_union": _yield_union,
        "province_abbrev": _province_abbrev,
        "yield_trend": _yield_trend,
        "yield_trend_ols": _yield_trend_ols,
        "yield_trend_summary": _yield_trend_summary,
        "yield_detrend": _yield_detrend,
        "normalized_yields": _normalized_yields,
        "classify_m5": _classify(5),
        "classify_m5_literal": _classify(5, literal=True),
        "classify_m6": _classify(6),
        "classify_m7": _classify(7),
        "classify_by_group": _classify_by_group,
        "period_mean": _period("hm_avg", "mean"),
        "period_sum": _period("pr_day", "sum"),
        "period_max": _period("ws_avg", "max"),
        "period_min": _period("tm_min", "min"),
        "period_gdd10c": _period("tm_avg", "gdd10c"),
        "feature_table": _feature_table,
        "feature_table_m5_literal": _period_literal,
        "feature_table_m7": _period_m7,
        "feature_yield": _feature_yield,
        "feature_yield_wide": _feature_yield_wide,
        "ols_all": _ols_all,
        "ols_summary": _ols_summary,
        "ols_by_province": _ols_by_province,
        "trend_points": _trend_points,
        "rollup_all_grains": _rollup_all_grains,
        "idw_all_grains": _idw_all_grains,
        "classify_calendars": _classify_calendars,
        "feature_table_calendars": _feature_table_calendars,
        "feature_yield_calendars": _feature_yield_calendars,
        "ols_summary_by_province": _ols_summary_by_province,
        "vif_by_province": _vif_by_province,
        "ols_merged_states": _ols_merged_states,
        "ols_mixed_widths": _ols_mixed_widths,
    }
    for grain in ru.GRAINS:
        out[f"rollup_{grain}"] = _rollup_query(grain)
        suffix = "" if grain == "month" else f"_{grain}"
        out[f"complete_groups{suffix}"] = _complete_query(grain)
        out[f"trim_edge_groups{suffix}"] = _trim(grain)
    out["drop_rows_at"] = _drop_rows
    out["drop_row_at"] = _drop_row("month", NEAR_ROW)
    out["drop_row_at_far"] = _drop_row("tenday", FAR_ROW)
    for name in regression.MODEL_VARIABLES:
        out[f"ols_{name}"] = _ols(regression.linear_model(name))
        out[f"ols_sq_{name}"] = _ols(regression.squared_model(name))
        out[f"vif_{name}"] = _vif(regression.linear_model(name))
        out[f"vif_sq_{name}"] = _vif(regression.squared_model(name))
    return {name: _finished(query) for name, query in out.items()}


def _finished(query: Query) -> Query:
    return lambda spark, d: rounded(query(spark, d))
