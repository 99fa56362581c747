"""Plans and skew: what must hold when the tables are a thousand times larger."""

import random

import pytest
from pyspark.sql import functions as F

from agriclime.functions.calendar import calendar_parts
from agriclime.operators import clean, phenology
from agriclime.operators import rollup as ru
from agriclime.operators.interpolate import nearest_reporting
from agriclime.sources import sample
from catalog import queries as catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.registered()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """No broadcasting, and partitions count as skewed early: large tables in small."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# The single models share their plan: one of them stands for all.
DISTINCT_PLANS = sorted(
    n for n in QUERIES
    if not n.startswith(("ols_", "vif_"))
    or n in ("ols_all", "ols_summary", "ols_by_province", "vif_tm_avg")
)


@pytest.mark.parametrize("name", DISTINCT_PLANS)
def test_no_query_compares_all_pairs(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "weather")
    sample.weather(spark, FOLDER).write.parquet(path)
    daily = calendar_parts(spark.read.parquet(path), years=(1998, None))
    text = plan(daily.groupBy("station", "year").agg(F.max("ws_avg")))
    assert "GreaterThanOrEqual(date,1998)" in text
    assert "ReadSchema: struct<station:int,date:string,ws_avg:double>" in text


def test_rollup_combines_before_its_only_shuffle(spark):
    text = plan(ru.rollup_climate(calendar_parts(sample.weather(spark, FOLDER)), "tenday"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_avg" in text


def test_features_share_one_scan_and_one_aggregation(spark):
    text = plan(QUERIES["feature_table"](spark, FOLDER))
    assert text.count("lineitem.parquet") == 1
    # One shuffle of partial results, one of the pivot.
    assert text.count("Exchange hashpartitioning") == 2 and "pivotfirst" in text


def test_sixteen_models_share_one_scan(spark):
    assert plan(QUERIES["ols_all"](spark, FOLDER)).count("lineitem.parquet") == 1


def hot_weather(spark, n=40_000):
    """A third of all rows belongs to one station."""
    station = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("int")
    day = F.date_add(F.lit("2001-01-01"), (F.col("id") % 365).cast("int")).cast("string")
    return spark.range(0, n, 1, 8).select(
        station.alias("station"), day.alias("date"), (F.col("id") % 31).cast("double").alias("tm_avg")
    )


@pytest.mark.parametrize("latest", [False, True])
def test_hot_station_is_split_in_the_join(shuffled, latest):
    spark = shuffled
    weather = hot_weather(spark)
    stations = spark.range(500).select(
        F.col("id").cast("int").alias("station"), F.lit("1990-01-01").alias("date_start"),
        F.lit("w").alias("wide"), F.concat(F.lit("n"), "id").alias("station_name"),
        (F.col("id") % 9).cast("string").alias("region"))
    joined = clean.station_join(weather, stations, one_per_station=latest)
    rows = joined.collect()
    assert len(rows) == 40_000 and all(r.station_name == f"n{r.station}" for r in rows)
    assert "SortMergeJoin(skew=true)" in plan(joined)


def test_hot_group_is_split_when_rules_are_rows(shuffled):
    spark = shuffled
    daily = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 97)).alias("wide"),
        F.lit(16).alias("tenday_no"), "id", F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    rules = spark.createDataFrame(
        [(w, 5, 3, "P2", 1, 5) for w in ["hot", *[f"w{i}" for i in range(97)]]],
        "wide string, month int, ten_day int, period string, lo int, hi int")
    out = phenology.classify_period_by_group(daily, rules)
    assert out.where("period = 'P2'").count() == 60_000
    out.collect()
    assert "SortMergeJoin(skew=true)" in plan(out)


def test_shuffled_interpolation_gives_the_same_rows(shuffled):
    spark = shuffled
    rnd = random.Random(4)
    near = [("w", f"r{g}", r, rnd.choice((7, rnd.randrange(60))) if r == 1 else 100 * g + r, float(r))
            for g in range(60) for r in range(1, 11)]
    obs = [(s, 2001, m, *[float(s % 5)] * 6)
           for s in {n[3] for n in near} for m in range(1, 13) if rnd.random() < 0.4]
    out = nearest_reporting(
        spark.createDataFrame(near, "wide string, region string, rank int, station int, dist double"),
        spark.createDataFrame(obs, "station int, year int, month int, tm_avg double, tm_min double, "
                                   "tm_max double, pr_sum double, hm_avg double, ss_dura double"))
    got = sorted((r.region, r.month, r.place, r.station) for r in out.collect())
    seen = {(o[0], o[2]) for o in obs}
    want = []
    for g in range(60):
        mine = [n for n in near if n[1] == f"r{g}"]
        for m in range(1, 13):
            hits = [n[3] for n in mine if (n[3], m) in seen][:3]
            want += [(f"r{g}", m, i, s) for i, s in enumerate(hits, 1)]
    assert got == sorted(want)


def test_weather_of_other_stations_is_dropped_before_the_rollup(spark):
    assert "LeftSemi" in plan(QUERIES["idw_month"](spark, FOLDER))


JOINED = ("station_join", "province_in", "equal_filter", "feature_table", "period_gdd10c", "region_day_mean")


@pytest.mark.parametrize("name", JOINED)
def test_weather_is_neither_broadcast_nor_shuffled_for_its_stations(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "BroadcastHashJoin" in text and "BuildLeft" not in text
    assert "SortMergeJoin" not in text
