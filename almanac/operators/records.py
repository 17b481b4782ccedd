"""Record days: the highest and lowest daily mean a station has for a calendar day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import day_key, format_day_key, parse_day_key
from almanac.operators.calendar import join_by_day
from almanac.operators.statistics import keyed


def record_extremes(df: DataFrame) -> DataFrame:
    """Highest and lowest TMEAN per station and calendar day over all rows, leap days included.

    Grouping and joining back reduces the history before any shuffle; a window over it would
    sort every row. Like a climatology, the result is worth storing for use with many series.
    """
    text = format_day_key(F.col("_day")).alias("DATE_MD")
    return extremes_by_day(df).select("STATION", text, "record_max", "record_min")


def extremes_by_day(df: DataFrame) -> DataFrame:
    """The same with the day as integer ``_day``, the key it was grouped by: in one plan with
    ``flag_records`` it is not shuffled again for the join."""
    return (
        keyed(df)
        .groupBy("STATION", day_key(F.col("DATE")).alias("_day"))
        .agg(F.max("TMEAN").alias("record_max"), F.min("TMEAN").alias("record_min"))
    )


def extremes_and_bounds(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``extremes_by_day``, and first and last day of each station, of one grouping of the history.

    Each of the two also looks at the columns of the other, or Spark would leave those out there,
    and group and shuffle the history twice. As it is the shuffle of one serves both.
    """
    days = keyed(df).groupBy("STATION", day_key(F.col("DATE")).alias("_day")).agg(
        F.max("TMEAN").alias("record_max"),
        F.min("TMEAN").alias("record_min"),
        F.min("DATE").alias("first_date"),
        F.max("DATE").alias("last_date"),
    ).where("_day is not null")  # as the join by day asks of its side
    extremes = days.where("first_date <= last_date").drop("first_date", "last_date")
    bounds = days.groupBy("STATION").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.max("record_max").alias("_high"), F.min("record_min").alias("_low"),
    )
    seen = F.coalesce("first_date", "last_date").isNotNull() | (F.col("_high") >= F.col("_low"))
    return extremes, bounds.where(seen).drop("_high", "_low")


def flag_records(df: DataFrame, extremes: DataFrame) -> DataFrame:
    """Flag the days that equal a record. Ties are all flagged, a missing mean never is.

    ``extremes`` comes from either function above.
    """
    if "_day" not in extremes.columns:
        key = parse_day_key(F.col("DATE_MD"))
        extremes = extremes.withColumn("_day", key).drop("DATE_MD")
    equals = {
        "is_record_high": F.col("TMEAN") == F.col("record_max"),
        "is_record_low": F.col("TMEAN") == F.col("record_min"),
    }
    return (
        join_by_day(df, extremes)
        .withColumns({c: F.coalesce(e, F.lit(False)) for c, e in equals.items()})
        .drop("record_max", "record_min")
    )


def record_days(df: DataFrame, extremes: DataFrame) -> DataFrame:
    """Only the rows that set or tie a record."""
    flagged = flag_records(df, extremes)
    return flagged.where(F.col("is_record_high") | F.col("is_record_low"))
