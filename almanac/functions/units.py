"""Unit conversions. The factors are fixed values."""

from __future__ import annotations

from pyspark.sql import Column


def kelvin_to_celsius(value: Column) -> Column:
    return value - 273.15


def metres_to_millimetres(value: Column) -> Column:
    return value * 1e3


def hundredths(value: Column) -> Column:
    """Sea-surface temperature is stored in 0.01 degrees."""
    return value * 0.01


def tenths(value: Column) -> Column:
    """Station values in the long export are stored in tenths."""
    return value / 10


def millimetres_to_centimetres(value: Column) -> Column:
    return value / 10
