"""Daily products: the climatology, and the observed series against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.bands import envelopes, std_bands
from almanac.operators.calendar import (
    join_climatology,
    join_observations,
    no_data_flags,
    station_calendar,
    with_day_key,
)
from almanac.operators.merge import single_days
from almanac.operators.prepare import ensure_prepared
from almanac.operators.records import extremes_and_bounds, flag_records
from almanac.operators.smoothing import circular_mean, impute_feb29
from almanac.operators.snow import (
    cumulative_snowfall,
    last_snowfall,
    split_at_last_snowfall,
)
from almanac.operators.spread import spread
from almanac.operators.statistics import (
    BASELINE_END,
    BASELINE_START,
    Day,
    baseline_days,
    between_days,
    daily_statistics,
    date_bounds,
    keyed,
    require_baseline,
    with_checked_baseline,
)
from almanac.schema import SNOW


def daily_climatology(
    df: DataFrame,
    start: Day = BASELINE_START,
    end: Day = BASELINE_END,
    window: int = 7,
    impute: bool = True,
    strict: bool | str = False,
) -> DataFrame:
    """Per station and calendar day: statistics over the baseline, 29 February imputed, then
    smoothed. ``strict`` makes a baseline the data does not reach an error: at once, by a job of its
    own, or with ``"on_read"`` in the job that reads the result.

    The result is the natural table to write once and use for many series.
    """
    df = ensure_prepared(df)
    if strict and strict != "on_read":
        require_baseline(df, end)
    climatology = daily_statistics(baseline_days(df, start, end))
    if strict == "on_read":
        climatology = with_checked_baseline(climatology, df, end)
    if impute:
        climatology = impute_feb29(climatology)
    return circular_mean(climatology, window)


def daily_series(
    df: DataFrame,
    climatology: DataFrame,
    start: Day,
    end: Day,
    records: bool | DataFrame = True,
    snow: bool = True,
    strict: bool = False,
    days_are_unique: bool = False,
) -> DataFrame:
    """Every station and day of the range with observation, climate, bands, envelopes, no-data
    flags and, if wanted, record flags and cumulative snowfall.

    ``records`` may be a stored table of record extremes; with ``True`` they are computed from the
    whole history. Days after a station's last row have climate values but ``in_data_range`` is
    false. Copies of a row are reduced, several rows of a day that differ are an error (pooled
    stations have such). Snow columns are left out if the table has no SNOW. ``strict`` makes a calendar day
    that is missing from the climatology an error. ``days_are_unique`` (true for any archive that an
    upsert wrote) leaves out the grouping that looks for copies.
    """
    df = ensure_prepared(df)
    observed = keyed(between_days(df, start, end))
    columns = ["STATION", "DATE", "PRCP", "TMAX", "TMIN", "TMEAN"]
    if records is True:
        records, bounds = extremes_and_bounds(df)
    else:
        bounds = date_bounds(df)
    one_each = (lambda rows: rows) if days_are_unique else single_days
    if snow and SNOW in df.columns:
        # The last day with snowfall goes along with the bounds, and the running total is made on
        # the rows that exist: neither needs a window over the whole calendar.
        bounds = bounds.join(last_snowfall(observed), "STATION", "left")
        observed = cumulative_snowfall(one_each(observed.select(*columns, SNOW)))
        spine = split_at_last_snowfall(station_calendar(bounds, start, end))
    else:
        observed = one_each(observed.select(*columns))
        spine = station_calendar(bounds, start, end)
    out = join_observations(with_day_key(spine), observed)
    # A task of the joins by day holds days, climate and records, sorted, and those it groups.
    out = spread(out, "STATION", "_day")
    out = join_climatology(out, climatology.withColumn("_in_climate", F.lit(True)))
    if strict:
        missing = F.raise_error(F.concat_ws(" ", F.lit("no climate for"), "STATION", "DATE_MD"))
        out = out.withColumn("_in_climate", F.coalesce("_in_climate", missing.cast("boolean")))
        out = out.where("_in_climate")
    out = out.drop("_in_climate")
    if isinstance(records, DataFrame):
        out = flag_records(out, records)
    out = out.drop("_day")
    return out.transform(std_bands).transform(envelopes).transform(no_data_flags)
