"""Daily table preparation: layout, date keys, daily mean, leap day and location filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac import schema
from almanac.functions import as_date_column, mean_of_present, to_measure
from almanac.functions.dates import LEAP_DAY_TEXT


def with_constants(df: DataFrame, **values: str | None) -> DataFrame:
    """Add text columns of one value each, such as the station and its label."""
    return df.withColumns({c: F.lit(v).cast("string") for c, v in values.items()})


def conform_daily(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The daily table in its fixed layout and types.

    Columns are picked by name, absent ones become null, ``SNOW`` stays if it is there and any
    other column (a saved index too) but those to ``keep`` is dropped. Dates and numbers may come
    as text.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(name: str) -> Column:
        return (F.col(name) if name in types else F.lit(None)).cast("string").alias(name)

    def measure(name: str) -> Column:
        if name not in types or isinstance(types[name], T.NullType):
            return F.lit(None).cast("double").alias(name)
        return to_measure(F.col(name), types[name]).alias(name)

    date = as_date_column(F.col("DATE"), types["DATE"]).alias("DATE")
    return df.select(
        text("STATION"),
        text("NAME"),
        date,
        *(measure(m) for m in schema.measures_of(types)),
        *keep,
    )


def with_date_keys(df: DataFrame) -> DataFrame:
    """Text keys of the date: day of the year, month of a year, month."""
    return df.withColumns(
        {
            "DATE_MD": F.date_format("DATE", "MM-dd"),
            "DATE_YM": F.date_format("DATE", "yyyy-MM"),
            "DATE_M": F.date_format("DATE", "MM"),
        }
    )


def with_daily_mean(df: DataFrame, use_average: bool = False) -> DataFrame:
    """TMEAN, the mean of the day's minimum and maximum (or the one that is there).
    ``use_average`` takes TAVG, the average that some stations report, where both are missing."""
    mean = mean_of_present(F.col("TMIN"), F.col("TMAX"))
    return df.withColumn("TMEAN", F.coalesce(mean, "TAVG") if use_average else mean)


def without_leap_day(df: DataFrame) -> DataFrame:
    """Drop 29 February; rows without a date stay."""
    return df.where(~F.col("DATE_MD").eqNullSafe(LEAP_DAY_TEXT))


def location_matches(location: str) -> Column:
    """The label contains the pattern (a regular expression), whatever the case."""
    return F.lower("NAME").rlike(location.lower())


def at_location(df: DataFrame, location: str) -> DataFrame:
    return df.where(location_matches(location))


def station_names(df: DataFrame) -> DataFrame:
    """The distinct location labels."""
    return df.select("NAME").distinct()


def validate_location(df: DataFrame, location: str) -> DataFrame:
    """Raise ``ValueError`` when no label matches. Runs a job; stops at the first match."""
    if at_location(df, location).select("NAME").isEmpty():
        raise ValueError(f"no location matches {location!r}; station_names lists those there are")
    return df


def pool_stations(df: DataFrame, station: str = "") -> DataFrame:
    """Treat all stations as one, so that statistics cover their rows together."""
    return df.withColumn("STATION", F.lit(station))


def prepare_daily(
    df: DataFrame,
    location: str | None = None,
    remove_feb29: bool = False,
    strict: bool = False,
    use_average: bool = False,
) -> DataFrame:
    """Daily table with date keys and daily mean, ready for the statistics; ``use_average`` as in
    ``with_daily_mean``.

    ``location`` keeps the stations whose label matches; ``strict`` makes a pattern without any
    match an error (this runs a job).
    """
    out = conform_daily(df)
    if location:
        if strict:
            validate_location(out, location)
        out = at_location(out, location)
    out = with_daily_mean(with_date_keys(out), use_average)
    return without_leap_day(out) if remove_feb29 else out


def ensure_prepared(df: DataFrame) -> DataFrame:
    return df if {"TMEAN", "DATE_MD"} <= set(df.columns) else prepare_daily(df)
