"""Bringing other layouts into the daily table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import hundredths, kelvin_to_celsius, metres_to_millimetres, tenths
from almanac.operators.merge import padding_rows, union_records
from almanac.operators.prepare import conform_daily, with_constants
from almanac.operators.reshape import (
    parse_compact_day,
    pivot_mean,
    pivot_unique,
    split_key,
)
from almanac.operators.statistics import Day


@dataclass(frozen=True)
class Profile:
    """How the features of a gridded source become daily columns."""

    columns: Mapping[str, tuple[str, Callable[[Column], Column]]]
    only_these_features: bool = False

    @property
    def features(self) -> list[str]:
        return sorted({feature for feature, _ in self.columns.values()})


# Feature names of the sources and their conversions.
PROFILES = {
    "era5": Profile(
        {
            "PRCP": ("total_precipitation", metres_to_millimetres),
            "TAVG": ("mean_2m_air_temperature", kelvin_to_celsius),
            "TMAX": ("maximum_2m_air_temperature", kelvin_to_celsius),
            "TMIN": ("minimum_2m_air_temperature", kelvin_to_celsius),
        }
    ),
    "oisst": Profile(
        {
            "TAVG": ("sst", hundredths),
            "TMAX": ("sst", hundredths),
            "TMIN": ("sst", hundredths),
        },
        only_these_features=True,
    ),
}


def normalize_gridded(pairs: DataFrame, profile: str = "era5") -> DataFrame:
    """Daily table of a point extract (``key``, ``value``), or of many points at once if there
    is a STATION column. Copies of a key are averaged."""
    p = PROFILES[profile]
    if "STATION" not in pairs.columns:
        pairs = with_constants(pairs, STATION="")
    rows = split_key(pairs)
    if p.only_these_features:
        rows = rows.where(F.col("feature").isin(*p.features))
    wide = parse_compact_day(pivot_mean(rows, p.features, ["STATION", "_day"]))
    values = [
        convert(F.col(feature)).alias(column) for column, (feature, convert) in p.columns.items()
    ]
    daily = wide.select("STATION", F.lit("").alias("NAME"), "DATE", *values)
    return conform_daily(daily)


# Data types the long export is asked for.
LONG_DATATYPES = ("PRCP", "SNOW", "TMAX", "TMIN")


def normalize_long(
    records: DataFrame,
    datatypes=LONG_DATATYPES,
    station: str | None = None,
    name: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Daily table of long records (``date``, ``datatype``, ``value`` in tenths).

    Records of several stations carry a STATION column; else ``station`` is put on every row.
    With ``start`` and ``end`` the missing days of the range become empty rows.
    """
    if "STATION" not in records.columns:
        records = with_constants(records, STATION=station)
    dated = records.withColumn("DATE", F.col("date").cast("date"))
    wide = pivot_unique(dated, datatypes, ["STATION", "DATE"])
    scaled = wide.select("STATION", "DATE", *(tenths(F.col(c)).alias(c) for c in datatypes))
    daily = conform_daily(with_constants(scaled, NAME=name))
    if start is None or end is None:
        return daily
    # The days come from the records, so that these are pivoted once.
    taken = dated.select("STATION", "DATE")
    stations = with_constants(taken.select("STATION").distinct(), NAME=name)
    return union_records(daily, padding_rows(stations, taken, start, end))
