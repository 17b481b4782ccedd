"""Products in order: files whose names are in the order of their rows, written by many tasks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACE = "place"


def write_ordered(
    df: DataFrame, path: str, by: Iterable[str | Column], files: int | None = None, format: str = "parquet"
) -> None:
    """Write a product, replacing what is at ``path``. Rows are dealt to tasks by ranges of ``by`` and
    ordered in each, so the files one after the other are the whole table in order. Rows that are
    equal in ``by`` are in the same file; name all columns that tell them apart."""
    by = list(by)
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    writer = ranged.sortWithinPartitions(*by).write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet product with ``place``, the number of each row in the order it was written in, from 1
    on. Files are counted, not gathered: a row's place is its number in the file and the rows of all
    files before."""
    rows = spark.read.parquet(path)
    columns = rows.columns
    at = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = at.groupBy("_file").agg(F.count("*").alias("_n"))
    # A row for each file. Part numbers have leading zeros, so names are in order.
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", F.coalesce(before, F.lit(0).cast("long")).alias("_before"))
    placed = at.join(offsets, "_file")
    return placed.select(*columns, (F.col("_before") + F.col("_row") + 1).alias(PLACE))
