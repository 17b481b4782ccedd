"""Leap-day imputation and moving means over finished statistics.

The windows here are keyed by station and run after the grouping: a station has at most 366
calendar days or one row per month, however many rows it was computed from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import full_frame_mean
from almanac.functions.dates import LEAP_DAY_TEXT
from almanac.operators.spread import spread

# The calendar days 29 February is imputed from.
LEAP_DAY_NEIGHBOURS = ("02-28", "03-01")


def _statistics(climatology: DataFrame) -> list[str]:
    return [c for c in climatology.columns if c not in ("STATION", "DATE_MD")]


def impute_feb29(climatology: DataFrame) -> DataFrame:
    """Add the row of 29 February: per statistic the mean of the neighbours that are there.

    A row the input may have for that day is replaced. Each station's first row carries the new
    one along, so the climatology is computed once and not a second time for a union. The old
    row is dropped here and not by a filter: that would be pushed below the grouping, where it
    formats the date of every input row. All windows have one order, so the rows are sorted once.
    The shuffle they need is one whose partitions stay small, as a moving mean sorts again behind it.
    """
    names = _statistics(climatology)
    ordered = Window.partitionBy("STATION").orderBy("DATE_MD")
    station = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_neighbour = F.col("DATE_MD").isin(*LEAP_DAY_NEIGHBOURS)
    imputed = {f"_{c}": F.avg(F.when(is_neighbour, F.col(c))).over(station) for c in names}
    is_first = F.row_number().over(ordered) == 1
    is_old = F.col("DATE_MD") == LEAP_DAY_TEXT
    own, new = F.lit(False), F.lit(True)
    copies = (
        F.when(is_first & is_old, F.array(new))
        .when(is_first, F.array(own, new))
        .when(~is_old, F.array(own))
    )

    def pick(new_value, name: str):
        return F.when(F.col("_new"), new_value).otherwise(F.col(name)).alias(name)

    return (
        spread(climatology, "STATION")
        .withColumns(imputed | {"_copies": copies})
        .select("STATION", "DATE_MD", *names, *imputed, F.explode("_copies").alias("_new"))
        .select(
            "STATION",
            pick(F.lit(LEAP_DAY_TEXT), "DATE_MD"),
            *(pick(F.col(f"_{c}"), c) for c in names),
        )
    )


def circular_mean(climatology: DataFrame, window: int = 7, strict: bool = False) -> DataFrame:
    """Trailing mean of ``window`` calendar days that wraps over New Year.

    Row i is the mean of rows i-window+1 .. i of its station, missing if any of them is. An even
    window leaves the values as they are, or is an error if ``strict``. What precedes the first row
    are the last ones, found in a list that goes along: copies of them would have to be sorted in, and
    a task would hold the rows once more.
    """
    if window < 1:
        raise ValueError("the window must be at least one day")
    if window % 2 == 0:
        if strict:
            raise ValueError("the window must be odd")
        return climatology
    if window == 1:
        return climatology
    names = _statistics(climatology)
    ordered = Window.partitionBy("STATION").orderBy("DATE_MD")
    station = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = climatology.withColumns(
        {"_pos": F.row_number().over(ordered), "_rows": F.count(F.lit(1)).over(station)}
    )
    last = F.when(F.col("_pos") > F.col("_rows") - (window - 1), F.struct(*names))
    first = F.when(F.col("_pos") < window, F.struct(*names))
    missing = F.lit(window) - F.col("_pos")
    wrapped = F.concat(F.slice("_last", -missing, missing), F.slice("_first", 1, F.col("_pos")))

    def mean(name: str) -> Column:
        value = F.col(name)
        total = F.lit(0.0)
        for k in range(window - 1, 0, -1):
            total = total + F.lag(value, k).over(ordered)
        over_new_year = F.aggregate("_wrapped", F.lit(0.0), lambda s, x: s + x[name])
        return (
            F.when(F.col("_pos") >= window, (total + value) / window)
            .when(F.size("_wrapped") == window, over_new_year / window)
            .alias(name)
        )

    return (
        numbered.withColumns(
            {"_last": F.collect_list(last).over(station), "_first": F.collect_list(first).over(station)}
        )
        .withColumn("_wrapped", F.when(missing > 0, wrapped))
        .select("STATION", "DATE_MD", *map(mean, names))
    )


def trailing_mean(
    monthly: DataFrame, feature: str, length: int, name: str = "trailing_values"
) -> DataFrame:
    """Mean of the last ``length`` month rows, missing unless all are there and not null.

    Rows count, not calendar months: a month without a row takes no place.
    """
    if length < 1:
        raise ValueError("the length must be at least one month")
    frame = (
        Window.partitionBy("STATION")
        .orderBy("DATE_YM")
        .rowsBetween(-(length - 1), Window.currentRow)
    )
    return monthly.withColumn(name, full_frame_mean(F.col(feature), frame, length))
