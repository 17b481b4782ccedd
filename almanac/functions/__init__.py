"""Column expressions shared by the operators."""

from almanac.functions.dates import (
    as_date_column,
    day_key,
    format_day_key,
    format_month_key,
    month_key,
    parse_day,
    parse_day_key,
    parse_month,
)
from almanac.functions.nulls import (
    full_frame_mean,
    greatest_or_null,
    least_or_null,
    mean_of_present,
    nan_to_null,
    sum_of_present,
    to_measure,
)
from almanac.functions.units import (
    hundredths,
    kelvin_to_celsius,
    metres_to_millimetres,
    millimetres_to_centimetres,
    tenths,
)

__all__ = [
    "as_date_column",
    "day_key",
    "format_day_key",
    "format_month_key",
    "full_frame_mean",
    "greatest_or_null",
    "hundredths",
    "kelvin_to_celsius",
    "least_or_null",
    "mean_of_present",
    "metres_to_millimetres",
    "millimetres_to_centimetres",
    "month_key",
    "nan_to_null",
    "parse_day",
    "parse_day_key",
    "parse_month",
    "sum_of_present",
    "tenths",
    "to_measure",
]
