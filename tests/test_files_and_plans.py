import pytest
from pyspark.sql import functions as F

from agriclime.functions.calendar import calendar_parts
from agriclime.operators.clean import date_complete, safe_station
from agriclime.plans.features import period_features_with_yield, region_daily
from agriclime.plans.yields import yields_from_files
from agriclime.plans.interpolation import interpolate_region_climate
from agriclime.sources import files, tables

WEATHER_CSV = """station,date,tm_avg,extra,tm_min,tm_max,pr_day,ws_avg,hm_avg,ss_dura_sum,rad_sum
90,2001-05-25,18.5,"x, y",NA,25,NA,2,60,7,NaN
junk,2001-05-26,1,,1,1,1,1,1,1,1
12.7,2001-05,2,,2,2,2,2,2,2,2
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_weather_csv(spark, tmp_path):
    df = files.read_weather(spark, write(tmp_path, "w.csv", WEATHER_CSV))
    types = dict(df.dtypes)
    assert types["date"] == types["station"] == types["extra"] == "string"
    assert types["tm_avg"] == "double"
    first = df.first()
    assert (first.tm_min, first.pr_day, first.rad_sum) == (None, None, None)
    assert first.extra == "x, y" and df.collect()[2].date == "2001-05"
    assert [r.station for r in date_complete(safe_station(df)).collect()] == [90]


def test_missing_columns_are_reported(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks"):
        files.read_regions(spark, write(tmp_path, "r.csv", "region\na\n"))


def test_other_csv_readers(spark, tmp_path):
    stations = write(tmp_path, "s.csv",
                     "station,unused,date_start,latitude,longitude,wide,station_name,region\n"
                     "90,x,1968-01-01,38.25,128.56,강원,속초,속초시\n")
    row = files.read_stations(spark, stations).first()
    assert (row.year_start, row.latitude, row.wide) == (1968, 38.25, "강원")
    assert "unused" not in row.asDict()
    yields = files.read_yields(
        spark, write(tmp_path, "y.csv", "시도,시군,연도,면적,단수,생산량\n충청남도,논산시,2001,10,500.5,NA\n"))
    assert tuple(yields.first()) == ("충청남도", "논산시", 2001, 10.0, 500.5, None)
    with pytest.raises(ValueError, match="expected 6"):
        files.read_yields(spark, write(tmp_path, "y2.csv", "a,b\n1,2\n"))


def test_yield_files_are_united_and_detrended(spark, tmp_path):
    head = "a,b,c,d,e,f\n"
    one = write(tmp_path, "1.csv", head + "충청남도,논산시,2001,1,500,1\n서울특별시,소계,2001,1,100,1\n")
    two = write(tmp_path, "2.csv", head + "전라북도,익산시,2011,1,520,1\n")
    rows = {r.wide: r for r in yields_from_files(spark, [one, two], (-3727.9392, 2.0988)).collect()}
    assert set(rows) == {"충남", "전북"}
    assert rows["충남"].prod_norm == pytest.approx(500 - (-3727.9392 + 2.0988 * 2001))
    fitted = {r.wide: r.prod_trend for r in yields_from_files(spark, [one, two]).collect()}
    assert fitted == {"충남": pytest.approx(300), "전북": pytest.approx(520)}


def test_sorted_csv(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 0), ("a", 1)], "wide string, year int")
    files.write_csv(df.repartition(3), str(tmp_path / "s"), ["wide", "year"])
    lines = [line for part in sorted((tmp_path / "s").glob("part-*"))
             for line in part.read_text().splitlines()[1:]]
    assert lines == ["a,1", "a,2", "b,1", "NA,0"]


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("w", None, 2001, 1 / 3), ("v", "r,\"x\"", 2002, None)],
        "wide string, region string, year int, tm_avg double")
    files.write_csv(df, str(tmp_path / "csv"))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    back = files.read_typed_csv(spark, str(tmp_path / "csv"), types)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    files.write_parquet(df, str(tmp_path / "pq"))
    pruned = spark.read.parquet(str(tmp_path / "pq")).where("year >= 2002")
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull(year" in (
        pruned._jdf.queryExecution().toString())


def test_stage_table_is_a_plain_scan(spark):
    df = spark.range(10).withColumn("year", (F.col("id") % 2).cast("int")).select("year", "id")
    stage = tables.materialize(df, partition_by=["year"])
    assert stage.columns == ["year", "id"] and stage.count() == 10
    assert "Range" not in stage._jdf.queryExecution().toString()


def test_stage_tables_go_to_the_named_folder(spark):
    folder = tables.shared_folder(spark)
    assert folder == tables.shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, folder)
    first, second = tables.new_path(spark, "x"), tables.new_path(spark, "x")
    assert first.startswith(folder) and first != second
    assert spark.sparkContext.applicationId in first


def test_csv_to_interpolation_and_features(spark, tmp_path):
    """All stages on tiny CSV files, by hand."""
    lines = ["station,date,tm_avg,tm_min,tm_max,pr_day,ws_avg,hm_avg,ss_dura_sum,rad_sum"]
    for station, shift in ((1, 0.0), (2, 6.0), (3, 3.0)):
        for day in (24, 25, 31):
            lines.append(f"{station},2001-05-{day},{15 + shift},10,20,2,{shift},60,7,9")
    weather = files.read_weather(spark, write(tmp_path, "w.csv", "\n".join(lines) + "\n"))
    stations = files.read_stations(spark, write(
        tmp_path, "s.csv",
        "station,date_start,latitude,longitude,wide,station_name,region\n"
        "1,1990-01-01,36,127,충남,a,논산시\n2,1990-01-01,36,129,충남,b,논산시\n"
        "3,1990-01-01,30,120,서울,c,서울\n"))
    geo = files.read_region_geo(spark, write(
        tmp_path, "g.csv", "wide,region,lat,lng\n충남,논산시,36,127.5\n"))
    daily = calendar_parts(safe_station(weather))
    month = interpolate_region_climate(daily, geo, stations, 2001, 2001, k=2)
    may = month.where("month = 5").first()
    assert month.count() == 12
    assert may.tm_avg == pytest.approx((15 / 0.5 + 21 / 1.5) / (1 / 0.5 + 1 / 1.5))
    assert may.pr_sum == pytest.approx(6.0)
    yields = spark.createDataFrame([("충남", "논산시", 2001, 512.0)],
                                   "wide string, region string, year int, prod_10a_kg double")
    rows = period_features_with_yield(region_daily(weather, stations), yields, 2001, 5, 3).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.wide, row.region, row.year, row.prod_10a_kg) == ("충남", "논산시", 2001, 512.0)
    assert (row.tm_avg_P1, row.pr_day_P1, row.ws_avg_P1) == (18.0, 12.0, 6.0)
    assert row.gdd10c_P1 == pytest.approx(3 * 5 + 3 * 11) and row.tm_avg_P2 is None
    assert len(row) == 44


TEXTS = [('a "q" b', 1.0), ('"quoted, all"', 2.0), ("서울, 부산", None), ("plain", 3.5), ("line", 4.0), (None, 5.0)]


def test_csv_keeps_quotes_commas_and_hangul(spark, tmp_path):
    path = str(tmp_path / "quotes")
    files.write_csv(spark.createDataFrame(TEXTS, "name string, v double"), path)
    written = "".join(p.read_text() for p in (tmp_path / "quotes").glob("part-*"))
    assert '"a ""q"" b"' in written and "\\" not in written
    back = files.read_typed_csv(spark, path, {"name": "string", "v": "double"})
    assert sorted(map(tuple, back.collect()), key=str) == sorted(TEXTS, key=str)


def test_csv_header_order_is_checked_in_every_file(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("lat,lng\n1.0,2.0\n")
    (folder / "b.csv").write_text("lng,lat\n3.0,4.0\n")
    with pytest.raises(Exception):
        files.read_typed_csv(spark, str(folder), {"lat": "double", "lng": "double"}).collect()


def test_csv_encoding(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("wide,region\nÎle,Évry\n".encode("latin-1"))
    row = files.read_regions(spark, str(path), encoding="ISO-8859-1").first()
    assert tuple(row) == ("Évry", "Île")


def test_files_with_headers_of_their_own(spark, tmp_path):
    """Two orders, a missing and an unknown column, quotes, NA; every row is accounted for."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('station,latitude,name\n1,1.5,"x, ""y"""\n2,NA,b\nthree,2.0,c\n4,2.5\n')
    (folder / "b.csv").write_text("name,latitude,station\nd,3.5,5\ne,bad,6\nf,1.0,7,too,many\n,NaN,8\n")
    (folder / "c.csv").write_text("latitude,station,more\n9.5,9,kept\n")
    (folder / "_hidden.csv").write_text("nothing\n1\n")
    (folder / "d.csv").write_text("station,latitude,name\n")
    types = {"station": "int", "latitude": "double", "name": "string"}
    rows, damaged = files.read_csv_files(spark, str(folder), types)
    assert rows.columns == ["station", "latitude", "name", "more"]
    assert sorted(tuple(r) for r in rows.collect()) == [
        (1, 1.5, 'x, "y"', None), (2, None, "b", None), (5, 3.5, "d", None), (8, None, None, None), (9, 9.5, None, "kept"),
    ]
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in damaged.collect()) == [
        ("a.csv", "4,2.5"), ("a.csv", "three,2.0,c"), ("b.csv", "e,bad,6"), ("b.csv", "f,1.0,7,too,many"),
    ]
    assert damaged.count() + rows.count() == 9


def test_folders_without_files_and_bad_headers(spark, tmp_path):
    rows, damaged = files.read_csv_files(spark, str(tmp_path), {"station": "int"})
    assert rows.collect() == [] and damaged.collect() == [] and rows.dtypes == [("station", "int")]
    (tmp_path / "x.csv").write_text("station,station\n1,2\n")
    with pytest.raises(ValueError, match="double names"):
        files.read_csv_files(spark, str(tmp_path), {"station": "int"})
