"""Grouped statistics: per calendar day, per month of a year, per month.

Every table is one ``groupBy`` with all its statistics, so it costs one scan and one shuffle of
partial aggregates; a station holding most of the rows is reduced before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import (
    day_key,
    format_day_key,
    format_month_key,
    month_key,
    parse_day,
)
from almanac.functions.dates import LEAP_DAY
from almanac.schema import SNOW

Day = str | dt.date | dt.datetime

# The default baseline, and the days a climate month's precipitation stands for.
BASELINE_START = "1981-01-01"
BASELINE_END = "2010-12-31"
DAYS_PER_CLIMATE_MONTH = 30


def keyed(df: DataFrame) -> DataFrame:
    """Rows that belong to a group: those with a station and a day."""
    return df.where(F.col("STATION").isNotNull() & F.col("DATE").isNotNull())


def between_days(df: DataFrame, start: Day | None, end: Day | None) -> DataFrame:
    """Rows in the closed date interval; an open side is None."""
    if start is not None:
        df = df.where(F.col("DATE") >= F.lit(parse_day(start)))
    if end is not None:
        df = df.where(F.col("DATE") <= F.lit(parse_day(end)))
    return df


def baseline_days(df: DataFrame, start: Day | None, end: Day | None) -> DataFrame:
    """Rows in the closed date interval, never 29 February."""
    return between_days(df, start, end).where(day_key(F.col("DATE")) != LEAP_DAY)


def _spread(columns, prefix: str = "doy_") -> list[Column]:
    """The temperature and snow statistics that all the tables share."""
    stats = [
        F.avg("TMEAN").alias(f"tmean_{prefix}mean"),
        F.stddev_samp("TMEAN").alias(f"tmean_{prefix}std"),
        F.max("TMAX").alias(f"tmax_{prefix}max"),
        F.stddev_samp("TMAX").alias(f"tmax_{prefix}std"),
        F.min("TMIN").alias(f"tmin_{prefix}min"),
        F.stddev_samp("TMIN").alias(f"tmin_{prefix}std"),
    ]
    if SNOW in columns:
        stats.append(F.avg(SNOW).alias(f"snow_{prefix}mean"))
    return stats


def daily_statistics(df: DataFrame) -> DataFrame:
    """Statistics per station and calendar day."""
    stats = _spread(df.columns)
    stats[2:2] = [
        F.max("TMEAN").alias("tmean_doy_max"),
        F.min("TMEAN").alias("tmean_doy_min"),
    ]
    grouped = keyed(df).groupBy("STATION", day_key(F.col("DATE")).alias("_day")).agg(*stats)
    names = [c for c in grouped.columns if c not in ("STATION", "_day")]
    return grouped.select("STATION", format_day_key(F.col("_day")).alias("DATE_MD"), *names)


def monthly_statistics(df: DataFrame, empty_sum: float | None = None) -> DataFrame:
    """Statistics per station and month of a year.

    ``empty_sum`` is the precipitation sum of a month without any value.
    """
    total = F.sum("PRCP")
    if empty_sum is not None:
        total = F.coalesce(total, F.lit(float(empty_sum)))
    grouped = (
        keyed(df)
        .groupBy("STATION", month_key(F.col("DATE")).alias("_month"))
        .agg(*_spread(df.columns), total.alias("prcp_sum"))
    )
    names = [c for c in grouped.columns if c not in ("STATION", "_month")]
    return grouped.select("STATION", format_month_key(F.col("_month")).alias("DATE_YM"), *names)


def monthly_aggregate(df: DataFrame, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Monthly statistics without leap days; a month with no value has no sum."""
    return monthly_statistics(baseline_days(df, start, end))


def monthly_climate(
    df: DataFrame, start: Day = BASELINE_START, end: Day = BASELINE_END
) -> DataFrame:
    """Statistics per station and month, pooled over the daily values of the baseline."""
    stats = _spread(df.columns)
    precipitation = (F.avg("PRCP") * DAYS_PER_CLIMATE_MONTH).alias("prcp_sum")
    return (
        keyed(baseline_days(df, start, end))
        .groupBy("STATION", F.month("DATE").alias("Month"))
        .agg(*stats, precipitation)
    )


def distinct_years(df: DataFrame) -> DataFrame:
    """How many calendar years each station has rows in."""
    return (
        keyed(df)
        .select("STATION", F.year("DATE").alias("_year"))
        .distinct()
        .groupBy("STATION")
        .agg(F.count("*").alias("n_years"))
    )


def monthly_climate_over_years(df: DataFrame) -> DataFrame:
    """Statistics per station and month over all rows, leap days included; precipitation is the
    daily mean times the number of years the station has rows in.

    The distinct count is an aggregate of its own: inside the main one it would multiply the rows.
    """
    stats = _spread(df.columns, prefix="")
    by_month = (
        keyed(df)
        .groupBy("STATION", F.month("DATE").alias("Month"))
        .agg(*stats, F.avg("PRCP").alias("_prcp"))
    )
    return (
        by_month.join(distinct_years(df), "STATION")
        .withColumn("prcp_mean", F.col("_prcp") * F.col("n_years"))
        .drop("_prcp", "n_years")
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last day of each station."""
    return (
        keyed(df)
        .groupBy("STATION")
        .agg(F.min("DATE").alias("first_date"), F.max("DATE").alias("last_date"))
    )


def baseline_status(df: DataFrame, end: Day = BASELINE_END) -> DataFrame:
    """Per station, whether its rows reach the end of the baseline.

    Valid means that the last day is at or after the end and the first day is not after it.
    """
    last = F.lit(parse_day(end))
    valid = (F.col("last_date") >= last) & (F.col("first_date") <= last)
    return date_bounds(df).withColumn("baseline_valid", valid)


def require_baseline(df: DataFrame, end: Day = BASELINE_END) -> DataFrame:
    """Raise ``ValueError`` if any station's rows do not reach the end of the baseline."""
    if not baseline_status(df, end).where(~F.col("baseline_valid")).isEmpty():
        raise ValueError(
            f"not enough data for climate normals up to {parse_day(end)}; "
            "baseline_status tells at which stations"
        )
    return df


def with_checked_baseline(result: DataFrame, df: DataFrame, end: Day = BASELINE_END) -> DataFrame:
    """A result by station, where a station whose rows in ``df`` do not reach the end of the baseline
    is an error when the result is read. Nothing runs before that."""
    text = F.concat_ws(
        " ", F.lit(f"not enough data for climate normals up to {parse_day(end)} at"), "STATION"
    )
    fine = F.when(F.col("baseline_valid"), True).otherwise(F.raise_error(text).cast("boolean"))
    return result.join(baseline_status(df, end).where(fine).select("STATION"), "STATION", "left_semi")
