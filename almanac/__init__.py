"""Daily weather-station records on Spark: climatologies, series against them, and the upkeep of
an archive, for all stations at once."""

from almanac.operators.prepare import prepare_daily
from almanac.plans import (
    backfill_plan,
    backfill_plan_from_index,
    climatology_from_state,
    daily_climatology,
    daily_series,
    monthly_series,
    normalize_gridded,
    normalize_long,
    rebuild_months,
    upsert_daily,
    upsert_daily_with_changes,
    upsert_published,
)
from almanac.sources import (
    VersionedTable,
    read_archive,
    read_daily,
    read_pairs,
    read_service_records,
    write_csv,
    write_daily,
)

__all__ = [
    "VersionedTable",
    "backfill_plan",
    "backfill_plan_from_index",
    "climatology_from_state",
    "daily_climatology",
    "daily_series",
    "monthly_series",
    "normalize_gridded",
    "normalize_long",
    "prepare_daily",
    "read_archive",
    "read_daily",
    "read_pairs",
    "read_service_records",
    "rebuild_months",
    "upsert_daily",
    "upsert_daily_with_changes",
    "upsert_published",
    "write_csv",
    "write_daily",
]
