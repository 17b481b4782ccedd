"""Reading and writing the daily station table."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import parse_day
from almanac.operators.prepare import conform_daily
from almanac.operators.statistics import Day, between_days
from almanac.schema import STRAY_INDEX_COLUMN
from almanac.sources.landing import read_service_records

FORMATS = ("parquet", "csv", "json")
# Folder column of an archive that ``write_daily`` wrote by year; not part of the table.
YEAR = "almanac_year"
# A date as the archives write it, with or without a time of day.
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"


def _all_iso(df: DataFrame) -> bool:
    """Whether all dates held as text are ISO text. Reads the dates, up to the first other one."""
    date = F.col("DATE")
    iso = date.rlike(ISO_DATE) & date.try_cast("date").isNotNull()
    return df.where(date.isNotNull() & ~iso).select("DATE").isEmpty()


def _within(df: DataFrame, start: Day | None, end: Day | None) -> DataFrame:
    """The date range, as a filter the file scan can use.

    Archives may hold the date as text. ISO text sorts like the dates, so the bounds are compared
    as text, which reaches the scan. If there is any other text, all dates are parsed instead:
    what is no date is an error, and what is one is found, with bounds as without. An archive with
    folders per year is read from the years of the range only.
    """
    if start is None and end is None:
        return df
    if YEAR in df.columns:
        if start is not None:
            df = df.where(F.col(YEAR) >= parse_day(start).year)
        if end is not None:
            df = df.where(F.col(YEAR) <= parse_day(end).year)
    if not isinstance(df.schema["DATE"].dataType, T.StringType):
        return between_days(df, start, end)
    if not _all_iso(df):
        return between_days(df.withColumn("DATE", F.col("DATE").cast("date")), start, end)
    if start is not None:
        df = df.where(F.col("DATE") >= parse_day(start).isoformat())
    if end is not None:
        df = df.where(F.col("DATE") < (parse_day(end) + dt.timedelta(days=1)).isoformat())
    return df


def _parquet_parts(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """The files with all columns that any of them has. Where files disagree on a type, such as
    dates held as text in some, those of one schema are a part."""
    paths = [path] if isinstance(path, str) else path
    try:
        return [spark.read.option("mergeSchema", True).parquet(*paths)]
    except Exception as e:  # raised by the JVM, as more than one Python class
        if "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
    groups: dict[str, list[str]] = {}
    for file in spark.read.parquet(*paths).inputFiles():
        groups.setdefault(spark.read.parquet(unquote(file)).schema.json(), []).append(unquote(file))
    return [spark.read.parquet(*files) for files in groups.values()]


def _csv_parts(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """The files with a header, those of one header as a part: columns are found by name in each."""
    lines = spark.read.text(path)
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if len(lines.inputFiles()) <= 1:
        return [reader.csv(path)]
    heads = (
        lines.select("value", "_metadata.file_path", "_metadata.file_block_start")
        .withColumn("at", F.monotonically_increasing_id())
        .where("file_block_start = 0")
        .groupBy("file_path")
        .agg(F.min_by("value", "at").alias("head"))
        .groupBy("head")
        .agg(F.collect_list("file_path").alias("files"))
    )
    return [reader.csv([unquote(f) for f in row["files"]]) for row in heads.orderBy("head").collect()]


def read_daily(
    spark: SparkSession,
    path: str | list[str],
    format: str = "parquet",
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Daily table from Parquet, CSV with a header, or landed service JSON.

    Columns are found by name in every file and brought to their types; the files need not have
    the same ones, and ``SNOW`` is there if any file has it. A path that does not exist is an error
    when the table is read. ``start`` and ``end`` limit the days at the scan; for dates held as text
    this takes a job that looks whether they are all ISO text. Several CSV files take one that
    reads their headers.
    """
    if format == "parquet":
        parts = _parquet_parts(spark, path)
    elif format == "csv":
        parts = _csv_parts(spark, path)
    elif format == "json":
        parts = [read_service_records(spark, path)]
    else:
        raise ValueError(f"format must be one of {FORMATS}, got {format!r}")
    tables = [conform_daily(_within(p.drop(STRAY_INDEX_COLUMN), start, end)) for p in parts]
    tables.sort(key=lambda t: -len(t.columns))  # SNOW comes last, and from those that have it
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_archive(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """An existing archive, without rows that have no station."""
    return read_daily(spark, path, format).dropna(subset=["STATION"])


def write_daily(
    df: DataFrame, path: str, clustered: bool = False, by_year: bool = False
) -> None:
    """Write the table as Parquet, replacing what is at ``path``.

    Never give the path the frame is read from: write next to it and switch. ``clustered`` sorts
    the files by station and day, so that later scans skip what they do not need by both; the
    ranges are cut by station *and* day, so a large station spreads over several files.
    ``by_year`` makes a folder per year, for archives that are mostly read for a range of days.
    """
    order = ["STATION", "DATE"]
    if by_year:
        df = df.withColumn(YEAR, F.year("DATE"))
        order = [YEAR, *order]
    if clustered or by_year:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite")
    if by_year:
        writer = writer.partitionBy(YEAR)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Write every value as text with a header, replacing what is at ``path``. Missing values
    are left empty."""
    text = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    text.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).csv(path)
