"""Cumulative snowfall over a range of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import millimetres_to_centimetres
from almanac.operators.merge import single_days
from almanac.schema import SNOW


def cumulative_snowfall(df: DataFrame) -> DataFrame:
    """Running snowfall in mm and cm per station; missing on days without a value, while the
    total goes on. Rows must be unique per station and day (``merge.single_days`` sees to it), so
    that a station has at most one row per day of the range."""
    so_far = (
        Window.partitionBy("STATION")
        .orderBy("DATE")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.when(F.col(SNOW).isNotNull(), F.sum(SNOW).over(so_far))
    return df.withColumn("snow_acc", total).withColumn(
        "snow_acc_cm", millimetres_to_centimetres(F.col("snow_acc"))
    )


def _last_day() -> Column:
    return F.max(F.when(F.col(SNOW) > 0, F.col("DATE")))


def last_snowfall(df: DataFrame) -> DataFrame:
    """The last day with snowfall of each station (``last_snow_date``); null if none."""
    return df.groupBy("STATION").agg(_last_day().alias("last_snow_date"))


def split_at_last_snowfall(df: DataFrame) -> DataFrame:
    """The two parts that ``last_snow_date`` cuts the range into. The day itself is in both;
    without snowfall no row is in either."""
    return df.withColumns(
        {
            "until_last_snow": F.coalesce(F.col("DATE") <= F.col("last_snow_date"), F.lit(False)),
            "from_last_snow": F.coalesce(F.col("DATE") >= F.col("last_snow_date"), F.lit(False)),
        }
    )


def snow_accumulation(df: DataFrame, days_are_unique: bool = False) -> DataFrame:
    """Cumulative snowfall of the rows, the last day with snowfall, and the parts it makes.

    ``days_are_unique`` (true for any archive that an upsert wrote) leaves out the grouping that
    reduces copies of a day and finds days that differ.
    """
    last = _last_day().over(Window.partitionBy("STATION"))
    return (
        (df if days_are_unique else single_days(df))
        .transform(cumulative_snowfall)
        .withColumn("last_snow_date", last)
        .transform(split_at_last_snowfall)
    )
