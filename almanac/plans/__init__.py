from almanac.plans.backfill import (
    backfill_plan,
    backfill_plan_from_index,
    rebuild_months,
    upsert_daily,
    upsert_daily_with_changes,
)
from almanac.plans.daily import daily_climatology, daily_series
from almanac.plans.monthly import monthly_series
from almanac.plans.normalize import normalize_gridded, normalize_long
from almanac.plans.upkeep import climatology_from_state, upsert_published

__all__ = [
    "backfill_plan",
    "backfill_plan_from_index",
    "climatology_from_state",
    "daily_climatology",
    "daily_series",
    "monthly_series",
    "normalize_gridded",
    "normalize_long",
    "rebuild_months",
    "upsert_daily",
    "upsert_daily_with_changes",
    "upsert_published",
]
