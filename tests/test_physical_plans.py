"""What the plans look like on a stored table: pruned scans, few shuffles, nothing in Python."""

import re

import pytest
from pyspark.sql import functions as F

from almanac import backfill_plan, daily_climatology, daily_series, monthly_series, read_daily
from almanac import upsert_daily, write_daily
from workload import tables as t

from conftest import SF_DIR, plan_of


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "daily")
    write_daily(t.station_daily(spark, SF_DIR), path, clustered=True)
    return read_daily(spark, path)


@pytest.fixture()
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def products(stored):
    climatology = daily_climatology(stored, *t.BASELINE)
    stations = stored.select("STATION", "NAME").distinct()
    return {
        "climatology": climatology,
        "series": daily_series(stored, climatology, *t.YEAR),
        "monthly": monthly_series(
            stored, information="Precipitation", anomaly=True, trailing=12,
            baseline_start=t.BASELINE[0], baseline_end=t.BASELINE[1],
        ),
        "backfill": backfill_plan(t.archive(stored), stations, *t.YEAR, t.DATATYPES),
        "upsert": upsert_daily(
            t.archive(stored), t.fetched(stored), stations, *t.YEAR, archive_is_unique=True
        ),
    }


def operators(plan):
    return re.findall(r"^\(\d+\) (.+)$", plan, flags=re.M)


def test_no_python_and_no_cross_joins(stored, no_broadcast):
    for name, df in products(stored).items():
        plan = plan_of(df)
        assert not re.search(r"Python|Pandas|Arrow", plan), name
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), name
        assert "BroadcastHashJoin" not in plan, name


def test_climatology_scans_the_baseline_only_and_shuffles_twice(stored):
    plan = plan_of(daily_climatology(stored, *t.BASELINE))
    ops = operators(plan)
    assert sum(o.startswith("Exchange") for o in ops) == 2
    assert sum(o.startswith("Scan parquet") for o in ops) == 1
    assert "GreaterThanOrEqual(DATE,1996-01-01), LessThanOrEqual(DATE,1999-12-31)" in plan
    schema = re.search(r"ReadSchema: (.+)", plan).group(1)
    assert "NAME" not in schema and "PRCP" not in schema


def test_no_date_is_formatted_before_the_grouping(stored):
    plan = plan_of(daily_climatology(stored, *t.BASELINE))
    scan_filter = re.search(r"Condition : (.+)", plan).group(1)
    assert "date_format" not in plan and "lpad" not in scan_filter


def test_every_window_is_keyed_by_station(stored, no_broadcast):
    for name, df in products(stored).items():
        plan = plan_of(df)
        for window in re.findall(r"Arguments: \[.*windowspecdefinition.*", plan):
            assert "windowspecdefinition(STATION" in window, (name, window)
        assert "SinglePartition" not in plan, name


def test_records_and_bounds_share_a_scan_and_a_shuffle(stored, no_broadcast):
    """One grouping of the history serves both, and the join by day does not shuffle it again."""
    climatology = daily_climatology(stored, *t.BASELINE)

    def parts(**options):
        series = daily_series(stored, climatology, *t.YEAR, snow=False, days_are_unique=True, **options)
        series.collect()
        plan = series._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return [len(re.findall(x, plan)) for x in ("FileScan parquet", "Exchange hash", "ReusedExchange")]

    with_records, without = parts(), parts(records=False)
    assert with_records[0] == without[0] == 3  # history, year, baseline
    assert with_records[2] == 1 and without[2] == 0
    # Bounds are grouped from the days of the year that the records are grouped by.
    assert with_records[1] - without[1] <= 2


def test_upsert_leaves_a_unique_archive_in_place_when_little_is_fetched(stored):
    plan = plan_of(products(stored)["upsert"])
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan


def test_leap_day_and_moving_mean_sort_the_climatology_once_each(stored):
    """Each further sort would hold all rows of a task again."""
    ops = operators(plan_of(daily_climatology(stored, *t.BASELINE)))
    assert sum(o == "Sort" or o.startswith("Sort ") for o in ops) == 2
    assert sum(o.startswith("Generate") for o in ops) == 1


def tasks_of(df):
    """In how many tasks the last stage makes rows."""
    return df.select("*", F.spark_partition_id().alias("_task")).select("_task").distinct().count()


def test_stages_that_hold_their_rows_several_times_use_all_shuffle_partitions(spark, stored, no_broadcast):
    """Few bytes would be put into one task, up to 64 MB of them."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    climatology = daily_climatology(stored, *t.BASELINE)
    assert tasks_of(climatology) > 1
    for span in (t.YEAR, t.WINTER, t.PAST_END):
        assert tasks_of(daily_series(stored, climatology, *span, days_are_unique=True)) == partitions
    assert tasks_of(t.station_daily(spark, SF_DIR)) > 1
