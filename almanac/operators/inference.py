"""Numeric columns among text columns: a column counts as numeric only if every value does."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.schema import KEY_COLUMNS

# Fixed value: a decimal number with an optional exponent, or an infinite one, between blanks.
NUMBER_PATTERN = (
    r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
)


def _text_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def _is_number(name: str) -> Column:
    """By the pattern. A cast takes more than numbers (Java's suffixes, hexadecimal digits), and one
    with guards against these takes half as long again."""
    return F.col(name).rlike(NUMBER_PATTERN)


def numeric_profile(df: DataFrame, exclude: Iterable[str] = KEY_COLUMNS) -> DataFrame:
    """One row per text column: how many values it has, how many are numbers, and the verdict.

    Empty text is a missing value. ``nan`` and other words are text here, unlike in a measure,
    where ``to_measure`` knows that a number is meant: here it is what decides the type.
    All columns are counted in one pass over the data.
    """
    columns = _text_columns(df, exclude)
    counts = df.agg(
        *(F.count_if(F.col(c) != "").alias(f"v_{i}") for i, c in enumerate(columns)),
        *(F.count_if(_is_number(c)).alias(f"n_{i}") for i, c in enumerate(columns)),
    )
    entries = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"v_{i}").alias("n_values"),
                F.col(f"n_{i}").alias("n_numbers"),
            )
            for i, c in enumerate(columns)
        )
    )
    return counts.select(F.inline(entries)).withColumn(
        "is_numeric", F.col("n_values") == F.col("n_numbers")
    )


def assign_numeric(df: DataFrame, exclude: Iterable[str] = KEY_COLUMNS) -> DataFrame:
    """Cast the all-numeric text columns to double, leave the others.

    Runs one job that returns a row per column. Key columns are never cast: a station id made
    of digits is still text.
    """
    if not _text_columns(df, exclude):
        return df
    numeric = {r["column"] for r in numeric_profile(df, exclude).collect() if r["is_numeric"]}
    return df.withColumns(
        {c: F.trim(F.nullif(c, F.lit(""))).cast("double") for c in df.columns if c in numeric}
    )
