"""Months against the climate of their month: departures, metric choice, sign classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import nan_to_null


@dataclass(frozen=True)
class Metric:
    value_column: str
    above: str
    below: str


# Value column and class labels by (information, anomaly).
METRICS = {
    ("temperature", True): Metric("tmean_diff", "Above average", "Below average"),
    ("temperature", False): Metric("tmean_doy_mean", "Above freezing", "Below freezing"),
    ("precipitation", True): Metric("prcp_diff", "Above average", "Below average"),
    ("precipitation", False): Metric("prcp_sum", "Monthly Precipitation", ""),
}


def choose_metric(information: str, anomaly: bool) -> Metric:
    try:
        return METRICS[information.lower(), bool(anomaly)]
    except KeyError:
        raise ValueError(
            f"information must be 'Temperature' or 'Precipitation', got {information!r}"
        ) from None


def with_month_parts(monthly: DataFrame) -> DataFrame:
    """First day of the month, month and year of a ``YYYY-MM`` key."""
    return monthly.withColumn("DATE", F.to_date("DATE_YM", "yyyy-MM")).withColumns(
        {"Month": F.month("DATE"), "Year": F.year("DATE")}
    )


def join_month_climate(monthly: DataFrame, climate: DataFrame) -> DataFrame:
    """Each month with the climate of its month; climate columns get the suffix ``_clim``."""
    renamed = climate.withColumnsRenamed(
        {c: f"{c}_clim" for c in climate.columns if c not in ("STATION", "Month")}
    )
    return monthly.join(renamed, ["STATION", "Month"], "left")


def join_complete_climate(monthly: DataFrame, climate: DataFrame) -> DataFrame:
    """The same without the stations that have a climate month without a precipitation value.

    The climate becomes one row for each station, with its months as a map of twelve at most, so
    that it is computed once for the gate and the join.
    """
    values = [c for c in climate.columns if c not in ("STATION", "Month")]
    month = F.struct("Month", F.struct(*values))
    stations = climate.groupBy("STATION").agg(
        F.map_from_entries(F.collect_list(month)).alias("_climate"),
        F.bool_or(nan_to_null(F.col("prcp_sum")).isNull()).alias("_incomplete"),
    )
    joined = monthly.join(stations, "STATION", "left")
    return joined.where(~F.coalesce("_incomplete", F.lit(False))).select(
        *monthly.columns,
        *(F.col("_climate")[F.col("Month")][c].alias(f"{c}_clim") for c in values),
    )


def departures(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "tmean_diff": F.col("tmean_doy_mean") - F.col("tmean_doy_mean_clim"),
            "prcp_diff": F.col("prcp_sum") - F.col("prcp_sum_clim"),
        }
    )


def value_class(df: DataFrame, metric: Metric) -> DataFrame:
    """The chosen value and its class: below zero, or zero and above; null has none."""
    value = F.col(metric.value_column)
    sign = F.when(value < 0, F.lit(metric.below)).when(value >= 0, F.lit(metric.above))
    return df.withColumns({"value": value, "value_class": sign})
