"""Keeping an archive complete: what to fetch, and how to merge what was fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.gaps import chunk_ranges, missing_ranges
from almanac.operators.merge import (
    KEYS,
    PADDED,
    changed_months,
    padding_rows,
    union_records,
    upsert_rows,
    upsert_with_changes,
)
from almanac.operators.prepare import conform_daily, ensure_prepared
from almanac.operators.presence import missing_ranges_of
from almanac.operators.statistics import Day, monthly_aggregate


def backfill_plan(
    archive: DataFrame,
    stations: DataFrame,
    start: Day,
    end: Day,
    datatypes: Sequence[str],
    padded: bool = True,
) -> DataFrame:
    """The requests that would complete the archive: contiguous missing days of each station,
    cut to the service's row limit. No rows if nothing is missing."""
    ranges = missing_ranges(archive, stations, start, end, padded)
    return chunk_ranges(ranges, len(datatypes))


def backfill_plan_from_index(
    index: DataFrame, stations: DataFrame, start: Day, end: Day, datatypes: Sequence[str]
) -> DataFrame:
    """As ``backfill_plan``, from a presence index; the archive is not read."""
    return chunk_ranges(missing_ranges_of(index, stations, start, end), len(datatypes))


def upsert_daily(
    archive: DataFrame | None,
    fetched: DataFrame,
    stations: DataFrame,
    start: Day,
    end: Day,
    pad: bool = True,
    archive_is_unique: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Archive, fetched rows and empty rows for the rest of the range, one per station and day.

    Fetched rows win over archive rows, archive rows over empty ones; of several fetched ones that
    with the highest ``order``, see ``upsert_rows``. ``stations`` (STATION, NAME) gives the labels.
    Running it again with the same rows changes nothing.
    """
    if archive is None:
        archive = fetched.limit(0)
    merged = upsert_rows(archive, fetched, archive_is_unique, stations, order)
    if not pad:
        return merged
    taken = union_records(*(conform_daily(p).select(*KEYS) for p in (archive, fetched)))
    return union_records(merged, padding_rows(stations, taken, start, end))


def upsert_daily_with_changes(
    archive: DataFrame,
    fetched: DataFrame,
    stations: DataFrame,
    start: Day,
    end: Day,
    archive_is_unique: bool = False,
    order: str | None = None,
) -> DataFrame:
    """As ``upsert_daily``, with the column ``change``: what happened to each day (``added``,
    ``corrected``, ``relabelled`` or ``padded``; null if nothing did). The rows with a change are the
    feed that derived tables are kept up from."""
    merged = upsert_with_changes(archive, fetched, archive_is_unique, stations, order)
    taken = union_records(*(conform_daily(p).select(*KEYS) for p in (archive, fetched)))
    padding = padding_rows(stations, taken, start, end)
    return union_records(merged, padding.withColumn("change", F.lit(PADDED)))


def rebuild_months(monthly: DataFrame, merged: DataFrame, changes: DataFrame) -> DataFrame:
    """Monthly statistics (``monthly_aggregate``) brought up to date: those of the months that
    ``changes`` touches are made anew from the merged days, all others are kept as they are."""
    keys = ["STATION", "DATE_YM"]
    touched = changed_months(changes)
    days = ensure_prepared(merged.drop("change"))
    again = monthly_aggregate(days.join(touched, keys, "left_semi"))
    return union_records(monthly.join(touched, keys, "left_anti"), again)
