"""Monthly product: values, departures from the climate, trailing mean and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import parse_day
from almanac.operators.departures import (
    choose_metric,
    departures,
    join_complete_climate,
    join_month_climate,
    value_class,
    with_month_parts,
)
from almanac.operators.prepare import ensure_prepared
from almanac.operators.smoothing import trailing_mean
from almanac.operators.statistics import (
    BASELINE_END,
    BASELINE_START,
    Day,
    monthly_aggregate,
    monthly_climate,
    require_baseline,
)


def monthly_series(
    df: DataFrame,
    start: Day | None = None,
    end: Day | None = None,
    information: str = "Temperature",
    anomaly: bool = False,
    trailing: int | None = None,
    baseline_start: Day = BASELINE_START,
    baseline_end: Day = BASELINE_END,
    strict: bool = False,
) -> DataFrame:
    """Every station and month with its statistics, the climate of the month, the departures,
    the chosen value and class, and the trailing mean of the value.

    Months are computed from the first one of the data and cut to ``start`` at the end, so that
    the trailing mean of the first month shown is complete. For the precipitation departure,
    stations with a climate month without any value are left out.
    """
    df = ensure_prepared(df)
    metric = choose_metric(information, anomaly)
    if strict:
        require_baseline(df, baseline_end)
    climate = monthly_climate(df, baseline_start, baseline_end)
    monthly = with_month_parts(monthly_aggregate(df, end=end))
    if metric.value_column == "prcp_diff":
        out = join_complete_climate(monthly, climate)
    else:
        out = join_month_climate(monthly, climate)
    out = departures(out)
    if trailing:
        out = trailing_mean(out, metric.value_column, trailing)
    out = value_class(out, metric)
    if start is not None:
        out = out.where(F.col("DATE") >= F.lit(parse_day(start).replace(day=1)))
    return out
