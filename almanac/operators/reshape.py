"""Key/value and long records to one row per day, by conditional aggregation.

One grouped pass per pivot: the cells are aggregates over the features that are known up front,
so there is no job that looks for them and only one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import nan_to_null


def explode_pairs(df: DataFrame, pairs: str = "pairs") -> DataFrame:
    """Rows of a map column ``key -> value``; the other columns are repeated."""
    others = [c for c in df.columns if c != pairs]
    return df.select(*others, F.explode(pairs).alias("key", "value"))


def split_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Day text and feature of a key ``YYYYMMDD_feature``; the day is parsed after grouping."""
    return df.withColumns(
        {"_day": F.substring(key, 1, 8), "feature": F.substr(F.col(key), F.lit(10))}
    ).drop(key)


def pivot_mean(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean of each feature per key. Missing values do not count, and a key with nothing but
    missing values has no row."""
    value = nan_to_null(F.col("value").cast("double"))
    return (
        df.withColumn("value", value)
        .where(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(*(F.avg(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features))
    )


def parse_compact_day(df: DataFrame) -> DataFrame:
    """DATE of the eight-digit day text; other text is an error."""
    return df.withColumn("DATE", F.to_date("_day", "yyyyMMdd")).drop("_day")


def pivot_unique(df: DataFrame, datatypes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Value of each data type per key. A cell given twice is an error, raised when the rows are
    computed."""

    def cell(name: str):
        mine = F.col("datatype") == name
        value = F.max(F.when(mine, nan_to_null(F.col("value").cast("double"))))
        message = F.lit(f"more than one value of {name} for the same day")
        return F.when(F.count_if(mine) > 1, F.raise_error(message)).otherwise(value).alias(name)

    return df.groupBy(*keys).agg(*(cell(n) for n in datatypes))
