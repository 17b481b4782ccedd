"""Column names and types of the daily station table."""

from __future__ import annotations

from pyspark.sql import types as T

# The archive layout, in file order.
DAILY_COLUMNS = ("STATION", "NAME", "DATE", "PRCP", "SNWD", "TAVG", "TMAX", "TMIN")
MEASURES = ("PRCP", "SNWD", "TAVG", "TMAX", "TMIN")
# Optional ninth column; kept wherever the input has it.
SNOW = "SNOW"

# Written by pandas when a frame is saved with its index.
STRAY_INDEX_COLUMN = "__index_level_0__"

KEY_COLUMNS = ("STATION", "NAME", "DATE")

DAILY = T.StructType(
    [
        T.StructField("STATION", T.StringType()),
        T.StructField("NAME", T.StringType()),
        T.StructField("DATE", T.DateType()),
        T.StructField("PRCP", T.DoubleType()),
        T.StructField("SNWD", T.DoubleType()),
        T.StructField("TAVG", T.DoubleType()),
        T.StructField("TMAX", T.DoubleType()),
        T.StructField("TMIN", T.DoubleType()),
    ]
)
DAILY_WITH_SNOW = T.StructType([*DAILY.fields, T.StructField(SNOW, T.DoubleType())])

# Landed service records: every measure may arrive as text or number, or not at all.
SERVICE_RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("STATION", "DATE", *MEASURES, SNOW)]
)


def measures_of(columns) -> tuple[str, ...]:
    """The measure columns of a daily table: the fixed five, and SNOW if it is there."""
    return (*MEASURES, SNOW) if SNOW in columns else MEASURES
