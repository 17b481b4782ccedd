"""Calendar keys and date arguments.

Grouping uses integer keys (``day_key`` 229 = 29 February, ``month_key`` 199602): formatting a
date costs more than the aggregation itself, so text keys are made once per result row
(``format_day_key``, ``format_month_key``) and not once per input row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAP_DAY = 229
LEAP_DAY_TEXT = "02-29"


def day_key(date: Column) -> Column:
    return F.month(date) * 100 + F.dayofmonth(date)


def month_key(date: Column) -> Column:
    return F.year(date) * 100 + F.month(date)


def format_day_key(key: Column) -> Column:
    """229 -> '02-29'."""
    text = F.lpad(key.cast("string"), 4, "0")
    return F.concat_ws("-", F.substring(text, 1, 2), F.substring(text, 3, 2))


def parse_day_key(text: Column) -> Column:
    """'02-29' -> 229."""
    return (F.substring(text, 1, 2).cast("int") * 100 + F.substring(text, 4, 2).cast("int"))


def format_month_key(key: Column) -> Column:
    """199602 -> '1996-02'."""
    text = F.lpad(key.cast("string"), 6, "0")
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))


def as_date_column(column: Column, data_type: T.DataType) -> Column:
    """Date of a date, timestamp or ISO text column. A date column passes unchanged, so that
    filters on it still reach the file scan. Bad text is an error."""
    return column if isinstance(data_type, T.DateType) else column.cast("date")


def parse_day(value: str | dt.date | dt.datetime) -> dt.date:
    """Date argument: ``YYYY-MM-DD`` text, a date or a datetime."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, str):
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    raise ValueError(f"expected a date or 'YYYY-MM-DD' text, got {value!r}")


def parse_month(value: str | dt.date | dt.datetime) -> dt.date:
    """Month argument: ``YYYY-MM`` text or a date; gives the first of the month."""
    if isinstance(value, str):
        return dt.datetime.strptime(value, "%Y-%m").date()
    return parse_day(value).replace(day=1)
