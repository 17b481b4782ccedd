"""Calendar rows per station and the joins onto them.

None of the joins forces a broadcast: a climatology has 366 rows per station and grows with the
stations, so Spark picks the strategy from the sizes it sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import day_key, nan_to_null, parse_day, parse_day_key
from almanac.operators.statistics import Day


def days_between(first: Column, last: Column) -> Column:
    """Every day from first to last; none if last is earlier."""
    step = F.expr("interval 1 day")
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(
        F.array().cast("array<date>")
    )


def calendar_spine(stations: DataFrame, start: Day, end: Day) -> DataFrame:
    """One row per given row of ``stations`` and day of the closed interval."""
    days = days_between(F.lit(parse_day(start)), F.lit(parse_day(end)))
    return stations.select(*stations.columns, F.explode(days).alias("DATE"))


def station_calendar(bounds: DataFrame, start: Day, end: Day) -> DataFrame:
    """Every day of the interval for each station of ``bounds`` (STATION, last_date).

    ``in_data_range`` tells the days up to the station's last day of data from those after it.
    Further columns of ``bounds`` are repeated.
    """
    spine = calendar_spine(bounds.drop("first_date"), start, end)
    in_range = F.col("DATE") <= F.col("last_date")
    return spine.withColumn("in_data_range", in_range).drop("last_date")


def with_day_key(df: DataFrame) -> DataFrame:
    """The calendar day of DATE: as text, and as the integer the joins below use.

    Both joins by calendar day take ``_day`` from here, so a series with climate and records is
    shuffled once for the two.
    """
    return df.withColumns(
        {"DATE_MD": F.date_format("DATE", "MM-dd"), "_day": day_key(F.col("DATE"))}
    )


def join_by_day(df: DataFrame, days: DataFrame) -> DataFrame:
    """Left join on station and integer calendar day; a ``_day`` the rows bring is kept."""
    if "_day" in df.columns:
        return df.join(days, ["STATION", "_day"], "left")
    keyed = df.withColumn("_day", day_key(F.col("DATE")))
    return keyed.join(days, ["STATION", "_day"], "left").drop("_day")


def join_climatology(spine: DataFrame, climatology: DataFrame) -> DataFrame:
    """Climate statistics of each spine day; null where the station has no such day."""
    days = climatology.withColumn("_day", parse_day_key(F.col("DATE_MD"))).drop("DATE_MD")
    return join_by_day(spine, days)


def join_observations(spine: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of each spine day; null where there is no row."""
    return spine.join(observations, ["STATION", "DATE"], "left")


def no_data_flags(df: DataFrame) -> DataFrame:
    """Days inside the data range without a mean temperature, or without precipitation."""
    return df.withColumns(
        {
            "no_data_temperature": F.col("in_data_range") & nan_to_null(F.col("TMEAN")).isNull(),
            "no_data_precipitation": F.col("in_data_range") & nan_to_null(F.col("PRCP")).isNull(),
        }
    )
