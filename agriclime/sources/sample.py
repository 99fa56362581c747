"""The engine's input tables, derived from the star-schema sample data.

Line items play the daily weather, suppliers the stations, nations the regions and
yearly order totals the yields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Scale of the price columns. A power of ten would leave many means of two-decimal
# prices exactly between two six-decimal values, where rounding depends on the order
# of summation.
PRICE_UNIT = 997.3


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = _read(spark, folder, "nation"), _read(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey)


def weather(spark: SparkSession, folder: str, sparse: bool = False) -> DataFrame:
    """Daily weather, one row per line item.

    ``sparse`` records radiation only on the returned items, so that many stations are
    incomplete in many periods and interpolation has to look further.
    """
    items = _read(spark, folder, "lineitem")
    measured = F.col("l_returnflag") == "R" if sparse else F.col("l_returnflag") != "N"
    # Whole percents: sums of them are exact in any order.
    percent_off = F.round(F.lit(100.0) * F.col("l_discount"))
    percent_tax = F.round(F.lit(100.0) * F.col("l_tax"))
    line = F.col("l_linenumber")
    return items.select(
        F.col("l_suppkey").cast("int").alias("station"),
        F.col("l_shipdate").cast("date").cast("string").alias("date"),
        F.col("l_quantity").alias("tm_avg"),
        (F.col("l_quantity") - percent_off).alias("tm_min"),
        (F.col("l_quantity") + percent_tax).alias("tm_max"),
        F.when(F.col("l_linestatus") != "O", percent_off).alias("pr_day"),
        F.when(line < 5, F.lit(40.0) + F.lit(5.0) * line).alias("hm_avg"),
        percent_tax.alias("ss_dura_sum"),
        F.when(measured, F.col("l_extendedprice") / F.lit(PRICE_UNIT)).alias("rad_sum"),
        (line + percent_off).alias("ws_avg"),
    )


def stations(spark: SparkSession, folder: str) -> DataFrame:
    supplier = _read(spark, folder, "supplier")
    key = F.col("s_suppkey")
    return supplier.join(
        _places(spark, folder), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        key.cast("int").alias("station"),
        (F.lit(33) + ((key * 37 + 11) % 101) / F.lit(20.2)).alias("latitude"),
        (F.lit(126) + ((key * 53 + 7) % 103) / F.lit(25.7)).alias("longitude"),
        F.col("r_name").alias("wide"),
        F.col("s_name").alias("station_name"),
        F.col("n_name").alias("region"),
    )


def station_history(spark: SparkSession, folder: str) -> DataFrame:
    """Two history entries per station, the second starting later."""
    key = F.col("station")
    starts = F.explode(F.array(F.lit("1973-01-01"), F.concat((1980 + key % 20), F.lit("-05-01"))))
    return stations(spark, folder).withColumn("date_start", starts)


def station_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Station history in which two stations of three have moved once during the weather's years."""
    key, first = F.col("station"), stations(spark, folder)
    later = first.where(key % 3 > 0).withColumns(
        {
            "latitude": F.lit(33) + ((key * 41 + 5) % 101) / F.lit(20.2),
            "longitude": F.lit(126) + ((key * 59 + 13) % 103) / F.lit(25.7),
            "station_name": F.concat("station_name", F.lit("_B")),
            "date_start": F.concat(1992 + key % 6, F.lit("-0"), 1 + key % 9, F.lit("-1"), key % 10),
        }
    )
    return first.withColumn("date_start", F.lit("1973-01-01")).unionByName(later)


def region_geo(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    return _places(spark, folder).select(
        F.col("r_name").alias("wide"),
        F.col("n_name").alias("region"),
        (F.lit(33.013) + ((key * 7 + 3) % 25) / F.lit(5.0)).alias("lat"),
        (F.lit(126.017) + ((key * 11 + 5) % 25) / F.lit(6.25)).alias("lng"),
    )


def region_list(spark: SparkSession, folder: str) -> DataFrame:
    """The regions that have a station."""
    return stations(spark, folder).select("wide", "region").distinct()


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as places of their own: a region table that grows with the data."""
    key = F.col("c_custkey")
    return _read(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("wide"),
        F.col("c_name").alias("region"),
        (F.lit(33.013) + ((key * 29 + 3) % 499) / F.lit(99.8)).alias("lat"),
        (F.lit(126.017) + ((key * 31 + 5) % 397) / F.lit(99.25)).alias("lng"),
    )


def yields(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = _read(spark, folder, "orders"), _read(spark, folder, "customer")
    by_region = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        _places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return by_region.groupBy(
        F.col("r_name").alias("wide"),
        F.col("n_name").alias("region"),
        F.year("o_orderdate").alias("year"),
    ).agg(
        F.count(F.lit(1)).cast("double").alias("area_ha"),
        (F.avg("o_totalprice") / F.lit(PRICE_UNIT)).alias("prod_10a_kg"),
        (F.sum("o_totalprice") / F.lit(PRICE_UNIT)).alias("prod_ton"),
    )


def split_by_year(yields: DataFrame) -> list[DataFrame]:
    """The yields as two tables, as they are delivered."""
    return [yields.where(F.col("year") <= 1998), yields.where(F.col("year") > 1998)]
