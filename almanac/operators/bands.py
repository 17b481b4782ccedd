"""Deviation bands and the envelopes of the observed series against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import greatest_or_null, least_or_null, sum_of_present


def std_bands(df: DataFrame) -> DataFrame:
    """Mean plus and minus one standard deviation.

    The two sides treat missing values differently, and that is meant to stay: the upper band
    counts a missing part as 0, the lower one is missing if a part is.
    """
    mean, std = F.col("tmean_doy_mean"), F.col("tmean_doy_std")
    return df.withColumns({"std_hi": sum_of_present(mean, std), "std_lo": mean - std})


def envelopes(df: DataFrame) -> DataFrame:
    """Outlines of the areas between observation and climate.

    Each is the larger or smaller of the day's mean temperature and a climate line, missing if
    either is.
    """
    observed = F.col("TMEAN")
    return df.withColumns(
        {
            "t_above": greatest_or_null(observed, F.col("tmean_doy_mean")),
            "t_above_std": greatest_or_null(observed, F.col("std_hi")),
            "t_below": least_or_null(observed, F.col("tmean_doy_mean")),
            "t_below_std": least_or_null(observed, F.col("std_lo")),
        }
    )
