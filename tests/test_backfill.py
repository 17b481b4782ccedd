import datetime as dt
import random

import pytest

from almanac import backfill_plan, upsert_daily
from almanac.operators import gaps, merge

from conftest import days, rows_of

YEAR = days("2001-01-01", 365)


@pytest.fixture(scope="module")
def sparse(daily):
    """Stations with random days missing, one complete, one with copies of rows."""
    rng = random.Random(7)
    rows = []
    for s in range(8):
        keep = [d for d in YEAR if rng.random() < s / 7]
        rows += [{"STATION": f"S{s}", "DATE": d.isoformat(), "PRCP": 1} for d in keep]
    rows += [{"STATION": "S7", "DATE": "2001-03-01", "PRCP": 2}] * 3
    rows += [{"STATION": "unwanted", "DATE": "2001-03-01", "PRCP": 2}]
    return daily(rows)


@pytest.fixture(scope="module")
def stations(spark):
    rows = [(f"S{s}", f"Station {s}") for s in range(8)] + [("new", "New")]
    return spark.createDataFrame(rows, "STATION string, NAME string")


def test_gaps_equal_runs_of_missing_days(sparse, stations):
    span = ("2000-12-30", "2002-01-03")
    columns = ("STATION", "range_start", "range_end", "n_days")
    fast = rows_of(gaps.missing_ranges(sparse, stations, *span), *columns)
    plain = rows_of(
        gaps.contiguous_ranges(gaps.missing_days(sparse, stations, *span)), *columns
    )
    assert fast == plain
    assert ("new", *span, 370) in fast


def test_chunks_cover_the_missing_days_once(sparse, stations):
    datatypes = [f"T{i}" for i in range(90)]  # 11 days per request
    plan = rows_of(
        backfill_plan(sparse, stations, "2001-01-01", "2001-12-31", datatypes),
        "STATION", "chunk_start", "chunk_end",
    )
    covered = []
    for s, a, b in plan:
        first, last = dt.date.fromisoformat(a), dt.date.fromisoformat(b)
        assert 0 <= (last - first).days < 11
        covered += [(s, d.isoformat()) for d in days(a, (last - first).days + 1)]
    missing = rows_of(gaps.missing_days(sparse, stations, "2001-01-01", "2001-12-31"), "STATION", "DATE")
    assert sorted(covered) == missing


def test_nothing_missing_gives_no_requests(daily, stations):
    full = daily([{"STATION": "S1", "DATE": d.isoformat(), "PRCP": 0} for d in YEAR[:31]])
    one = stations.where("STATION = 'S1'")
    assert backfill_plan(full, one, "2001-01-01", "2001-01-31", ["PRCP"]).isEmpty()
    assert gaps.missing_ranges(full, one, "2001-01-31", "2001-01-01").isEmpty()


def test_padding_is_asked_for_again(daily, stations):
    df = daily(
        [{"STATION": "S1", "DATE": "2001-01-01", "PRCP": 1}, {"STATION": "S1", "DATE": "2001-01-02"}]
    )
    one = stations.where("STATION = 'S1'")
    span = ("2001-01-01", "2001-01-02")
    assert rows_of(gaps.missing_days(df, one, *span), "DATE") == [("2001-01-02",)]
    assert gaps.missing_days(df, one, *span, padded=False).isEmpty()


def test_chunk_size():
    assert gaps.chunk_days(3) == 333
    assert gaps.chunk_days(1000) == 1
    for n in (0, 1001):
        with pytest.raises(ValueError):
            gaps.chunk_days(n)


def test_pad_calendar_keeps_rows_and_fills_days(daily, stations):
    df = daily([{"STATION": "S1", "DATE": "2001-01-02", "PRCP": 5}, {"STATION": "S1", "DATE": "1999-01-01"}])
    out = merge.pad_calendar(df, stations.where("STATION = 'S1'"), "2001-01-01", "2001-01-03")
    assert rows_of(out, "DATE", "NAME", "PRCP") == [
        ("1999-01-01", "Alpha", None), ("2001-01-01", "Station 1", None),
        ("2001-01-02", "Alpha", 5.0), ("2001-01-03", "Station 1", None),
    ]


def test_upsert_order_and_idempotence(daily, stations):
    one = stations.where("STATION = 'S1'")
    archive = daily(
        [
            {"STATION": "S1", "NAME": "old", "DATE": "2001-01-01", "PRCP": 1},
            {"STATION": "S1", "NAME": "old", "DATE": "2001-01-02", "PRCP": 2},
            {"STATION": None, "NAME": "old", "DATE": "2001-01-03"},
        ]
    )
    fetched = daily(
        [
            {"STATION": "S1", "NAME": None, "DATE": "2001-01-02", "PRCP": 20},
            {"STATION": None, "NAME": None, "DATE": "2001-01-01", "PRCP": 9},
        ]
    )
    span = ("2001-01-01", "2001-01-03")
    once = upsert_daily(archive, fetched, one, *span)
    want = [
        ("S1", "2001-01-01", "old", 1.0), ("S1", "2001-01-02", "Station 1", 20.0),
        ("S1", "2001-01-03", "Station 1", None),
    ]
    columns = ("STATION", "DATE", "NAME", "PRCP")
    assert rows_of(once, *columns) == want
    assert rows_of(upsert_daily(once, fetched, one, *span), *columns) == want
    assert rows_of(upsert_daily(once, fetched, one, *span, archive_is_unique=True), *columns) == want


def test_upsert_removes_copies_and_starts_from_nothing(daily, stations):
    one = stations.where("STATION = 'S1'")
    copies = daily([{"STATION": "S1", "DATE": "2001-01-01", "PRCP": p} for p in (3, 1, 2)])
    none = daily([], snow=False)
    assert rows_of(upsert_daily(copies, none, one, "2001-01-01", "2001-01-01"), "PRCP") == [(3.0,)]
    assert rows_of(upsert_daily(None, copies, one, "2001-01-01", "2001-01-02"), "DATE", "PRCP") == [
        ("2001-01-01", 3.0), ("2001-01-02", None),
    ]


def test_union_of_parts_fills_absent_columns(daily):
    a, b = daily([{"DATE": "2001-01-01"}]), daily([{"DATE": "2001-01-02", "SNOW": 1}])
    assert rows_of(merge.union_records(a, b), "DATE", "SNOW") == [
        ("2001-01-01", None), ("2001-01-02", 1.0),
    ]
