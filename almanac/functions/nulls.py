"""Null rules. Missing is always NULL: NaN is turned into NULL where data enters."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a missing number is spelled in text files.
MISSING_TEXT = ("", "nan", "none", "null")


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def to_measure(value: Column, data_type: T.DataType) -> Column:
    """A measure as double. Text other than a number or a missing marker is an error."""
    if isinstance(data_type, T.StringType):
        missing = F.lower(F.trim(value)).isin(*MISSING_TEXT)
        value = F.when(~missing, F.trim(value))
    return nan_to_null(value.cast("double"))


def mean_of_present(a: Column, b: Column) -> Column:
    """Mean of two values; if one is missing, the other one."""
    return F.coalesce((a + b) / 2, a, b)


def sum_of_present(*values: Column) -> Column:
    """Sum in which a missing value counts as 0."""
    total = F.coalesce(values[0], F.lit(0.0))
    for v in values[1:]:
        total = total + F.coalesce(v, F.lit(0.0))
    return total


def greatest_or_null(a: Column, b: Column) -> Column:
    """Larger of two values, missing if either is (``greatest`` alone skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def least_or_null(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def full_frame_mean(value: Column, frame: WindowSpec, rows: int) -> Column:
    """Mean over a row frame, missing unless all ``rows`` rows are there and not null."""
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))
