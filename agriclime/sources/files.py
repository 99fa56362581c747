"""CSV readers with explicit types, and the CSV / Parquet writers."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import null_out_nan
from .tables import materialize, partitioned_writer

# Column names and types of the input files.
WEATHER_TYPES = {
    "station": "string",
    "date": "string",
    "tm_avg": "double",
    "tm_min": "double",
    "tm_max": "double",
    "pr_day": "double",
    "ws_avg": "double",
    "ws_max": "double",
    "hm_avg": "double",
    "ss_dura_sum": "double",
    "rad_sum": "double",
}
STATION_TYPES = {
    "station": "int",
    "date_start": "string",
    "latitude": "double",
    "longitude": "double",
    "wide": "string",
    "station_name": "string",
    "region": "string",
}
REGION_TYPES = {"region": "string", "wide": "string"}
REGION_GEO_TYPES = {"wide": "string", "region": "string", "lat": "double", "lng": "double"}
YIELD_COLUMNS = ("wide", "region", "year", "area_ha", "prod_10a_kg", "prod_ton")
YIELD_TYPES = ("string", "string", "int", "double", "double", "double")


DAMAGED, FILE = "_damaged", "_file"


def _schema(names: Sequence[str], types: Mapping[str, str]) -> T.StructType:
    ddl = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, ddl[types.get(n, "string")], True) for n in names])


# Quotes inside a quoted text are doubled, on reading and on writing.
QUOTING = {"quote": '"', "escape": '"'}


def _csv_options(spark: SparkSession, encoding: str):
    """Options of every reader; a part file whose header differs from the schema is an error.

    Columns are taken by position, so a file with the same names in another order would
    otherwise be read into the wrong ones.
    """
    return spark.read.options(
        header=True, nullValue="NA", nanValue="NaN", enforceSchema=False, encoding=encoding, **QUOTING
    )


def header_names(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of a CSV file; reads the header line only."""
    return spark.read.options(header=True, encoding=encoding, **QUOTING).csv(path).columns


def read_typed_csv(
    spark: SparkSession, path: str, types: Mapping[str, str], encoding: str = "UTF-8"
) -> DataFrame:
    """Read a CSV whose known columns are typed by name and whose others stay text.

    Types are never inferred: inference would turn a damaged date such as
    '2001-01' into a timestamp. Columns nobody selects are not parsed.
    """
    names = header_names(spark, path, encoding)
    missing = [c for c in types if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    df = _csv_options(spark, encoding).schema(_schema(names, types)).csv(path)
    return null_out_nan(df)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or glob names, without hidden ones, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in files.globStatus(hadoop) or []:
        listed = files.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [f.getPath().toString() for f in listed if f.isFile() and f.getPath().getName()[0] not in "._"]
    return sorted(out)


def header_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The first line of a file, without reading on."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_csv_files(
    spark: SparkSession, path: str, types: Mapping[str, str], encoding: str = "UTF-8"
) -> tuple[DataFrame, DataFrame]:
    """(rows, damaged) of all files of a folder, whatever the order of their columns.

    Files are grouped by their header, each group is read with its own schema, and the groups
    are united by name; a known column that a file lacks is null there, unknown ones stay
    text. ``damaged`` has ``file`` and ``line`` of every row that does not parse: a text
    where a number belongs, or too few or too many fields. Such rows are not among ``rows``,
    so every row of every file is in exactly one of both. The parsed rows are stored once.

    The driver reads one line of each file. Quoted texts hold no line breaks.
    """
    by_header: dict[str, list[str]] = {}
    for file in data_files(spark, path):
        by_header.setdefault(header_line(spark, file, encoding).lstrip("\ufeff"), []).append(file)
    parsed = None
    for header, files in by_header.items():
        names = next(csv.reader([header]), [])
        if len(set(names)) < len(names) or not names:
            raise ValueError(f"{files[0]} has a header with missing or double names: {header!r}")
        schema = _schema(names, types).add(DAMAGED, T.StringType())
        reader = _csv_options(spark, encoding).options(mode="PERMISSIVE", columnNameOfCorruptRecord=DAMAGED)
        part = null_out_nan(reader.schema(schema).csv(files)).select(
            *names, F.col(DAMAGED), F.col("_metadata.file_path").alias(FILE)
        )
        parsed = part if parsed is None else parsed.unionByName(part, allowMissingColumns=True)
    if parsed is None:
        parsed = spark.createDataFrame([], _schema(list(types), types).add(DAMAGED, "string").add(FILE, "string"))
    absent = {c: F.lit(None).cast(t) for c, t in types.items() if c not in parsed.columns}
    # Stored: else a query of the damaged rows alone would parse no other column.
    stored = materialize(parsed.withColumns(absent), "csv-rows")
    rows = stored.where(F.col(DAMAGED).isNull()).drop(DAMAGED, FILE)
    damaged = stored.where(F.col(DAMAGED).isNotNull()).select(F.col(FILE).alias("file"), F.col(DAMAGED).alias("line"))
    return rows.select(*types, *[c for c in rows.columns if c not in types]), damaged


def read_weather(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    names = set(header_names(spark, path, encoding))
    wanted = {c: t for c, t in WEATHER_TYPES.items() if c != "ws_max" or c in names}
    return read_typed_csv(spark, path, wanted, encoding)


def read_stations(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Station metadata with the year its history starts."""
    df = read_typed_csv(spark, path, STATION_TYPES, encoding).select(*STATION_TYPES)
    return with_year_start(df)


def with_year_start(stations: DataFrame) -> DataFrame:
    start = F.substring("date_start", 1, 4).try_cast("int")
    return stations.withColumn("year_start", start)


def read_regions(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return read_typed_csv(spark, path, REGION_TYPES, encoding).select(*REGION_TYPES)


def read_region_geo(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return read_typed_csv(spark, path, REGION_GEO_TYPES, encoding).select(*REGION_GEO_TYPES)


def read_yields(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One yield file; its own header names are replaced by position."""
    found = header_names(spark, path, encoding)
    if len(found) != len(YIELD_COLUMNS):
        raise ValueError(f"{path} has {len(found)} columns, expected {len(YIELD_COLUMNS)}")
    schema = _schema(found, dict(zip(found, YIELD_TYPES)))
    read = _csv_options(spark, encoding).schema(schema).csv(path)
    return null_out_nan(yield_names(read))


def yield_names(df: DataFrame) -> DataFrame:
    """The yield columns' own names instead of those of the file, by position."""
    return df.toDF(*YIELD_COLUMNS)


def write_csv(
    df: DataFrame, path: str, sort_by: Sequence[str] = (), encoding: str = "UTF-8"
) -> None:
    """Write part files with a header; missing values as NA.

    ``sort_by`` orders the rows over all part files (missing values last): rows are
    a set until they are written.
    """
    if sort_by:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in sort_by])
    writer = df.write.options(header=True, nullValue="NA", encoding=encoding, **QUOTING)
    writer.mode("overwrite").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",)) -> None:
    """Write Parquet, by default in one folder per year so that year filters prune files."""
    partitioned_writer(df, partition_by).mode("overwrite").parquet(path)
