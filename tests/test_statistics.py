import datetime as dt

import numpy as np
import pytest

from almanac import daily_climatology, prepare_daily
from almanac.operators import smoothing, statistics

from conftest import days, rows_of


def climatology(spark, values_by_station):
    """One row per station and consecutive calendar day of 2001."""
    rows = [
        (s, d.strftime("%m-%d"), v)
        for s, values in values_by_station.items()
        for d, v in zip(days("2001-01-01", len(values)), values)
    ]
    return spark.createDataFrame(rows, "STATION string, DATE_MD string, x double")


def circular(values, n):
    out = []
    for i in range(len(values)):
        frame = [values[(i - k) % len(values)] for k in range(n)]
        out.append(None if None in frame else sum(frame) / n)
    return out


@pytest.mark.parametrize("n", [3, 7, 31])
def test_circular_mean_is_trailing_and_wraps(spark, n):
    rng = np.random.default_rng(n)
    values = {f"S{k}": [float(v) for v in rng.normal(size=40 + k)] for k in range(6)}
    values["gap"] = [None if i == 5 else float(i) for i in range(50)]
    got = {}
    for s, md, x in rows_of(
        smoothing.circular_mean(climatology(spark, values), n), "STATION", "DATE_MD", "x"
    ):
        got.setdefault(s, []).append(x)
    for s, v in values.items():
        want = circular(v, n)
        assert [g is None for g in got[s]] == [w is None for w in want]
        assert all(abs(g - w) < 1e-9 for g, w in zip(got[s], want) if w is not None)


def test_circular_mean_keeps_the_mean_of_complete_data(spark):
    values = [float(v) for v in np.random.default_rng(0).normal(size=365)]
    got = smoothing.circular_mean(climatology(spark, {"S": values}), 7).agg({"x": "avg"}).first()[0]
    assert abs(got - np.mean(values)) < 1e-9


def test_circular_mean_window_choices(spark):
    df = climatology(spark, {"S": [1.0, 2.0, 4.0]})
    same = [("01-01", 1.0), ("01-02", 2.0), ("01-03", 4.0)]
    assert rows_of(smoothing.circular_mean(df, 1), "DATE_MD", "x") == same
    assert rows_of(smoothing.circular_mean(df, 2), "DATE_MD", "x") == same
    with pytest.raises(ValueError):
        smoothing.circular_mean(df, 2, strict=True)
    with pytest.raises(ValueError):
        smoothing.circular_mean(df, 0)


def test_fewer_rows_than_the_window(spark):
    got = rows_of(smoothing.circular_mean(climatology(spark, {"S": [1.0, 2.0, 3.0, 4.0]}), 7), "x")
    # Positions -3..0 precede the four rows; only the last two have seven rows behind them.
    assert sorted((x for (x,) in got if x is not None)) == pytest.approx([16 / 7, 19 / 7])
    assert len(got) == 4


def test_leap_day_is_the_mean_of_the_neighbours_that_are_there(spark):
    rows = [
        ("both", "02-28", 1.0), ("both", "03-01", 4.0),
        ("one", "02-28", 1.0), ("one", "12-31", 9.0),
        ("none", "07-01", 5.0),
        ("null", "02-28", None), ("null", "03-01", 4.0),
        ("old", "02-28", 2.0), ("old", "02-29", 100.0), ("old", "03-01", 4.0),
        ("only", "02-29", 100.0),
    ]
    df = spark.createDataFrame(rows, "STATION string, DATE_MD string, x double")
    got = smoothing.impute_feb29(df)
    assert rows_of(got.where("DATE_MD = '02-29'"), "STATION", "x") == [
        ("both", 2.5), ("none", None), ("null", 4.0), ("old", 3.0), ("one", 1.0), ("only", None),
    ]
    assert got.count() == len(rows) + 4


def test_imputation_comes_before_smoothing(daily):
    rows = [
        {"DATE": d.isoformat(), "TMAX": d.day, "TMIN": d.day} for d in days("2001-01-01", 365)
    ]
    clim = daily_climatology(daily(rows), "2001-01-01", "2001-12-31", window=3)
    got = dict(rows_of(clim, "DATE_MD", "tmean_doy_mean"))
    assert len(got) == 366
    assert got["02-29"] == pytest.approx((27 + 28 + 14.5) / 3)
    assert got["03-01"] == pytest.approx((28 + 14.5 + 1) / 3)
    assert got["01-01"] == pytest.approx((30 + 31 + 1) / 3)


def test_single_value_has_no_deviation_and_null_only_groups_stay(daily):
    df = prepare_daily(daily([{"DATE": "2001-01-01", "TMAX": 3, "TMIN": 1}, {"DATE": "2001-01-02"}]))
    got = rows_of(
        statistics.daily_statistics(df), "DATE_MD", "tmean_doy_mean", "tmean_doy_std", "tmax_doy_max"
    )
    assert got == [("01-01", 2.0, None, 3.0), ("01-02", None, None, None)]


def test_baseline_is_closed_and_without_leap_days(daily):
    df = daily([{"DATE": d} for d in ("1995-12-31", "1996-01-01", "1996-02-29", "1999-12-31")])
    got = rows_of(statistics.baseline_days(df, "1996-01-01", "1999-12-31"), "DATE")
    assert got == [("1996-01-01",), ("1999-12-31",)]


def test_month_without_precipitation(daily):
    df = prepare_daily(daily([{"DATE": "2001-01-01", "TMAX": 1}, {"DATE": "2001-02-01", "PRCP": 2}]))
    null_sum = rows_of(statistics.monthly_aggregate(df), "DATE_YM", "prcp_sum")
    zero_sum = rows_of(statistics.monthly_statistics(df, empty_sum=0), "DATE_YM", "prcp_sum")
    assert null_sum == [("2001-01", None), ("2001-02", 2.0)]
    assert zero_sum == [("2001-01", 0.0), ("2001-02", 2.0)]


def test_february_sums_leave_out_the_leap_day(daily):
    df = prepare_daily(daily([{"DATE": f"2000-02-{d}", "PRCP": 1} for d in (27, 28, 29)]))
    assert rows_of(statistics.monthly_aggregate(df), "prcp_sum") == [(2.0,)]
    assert rows_of(statistics.monthly_statistics(df), "prcp_sum") == [(3.0,)]


def test_month_climate_pools_days(daily):
    rows = [{"DATE": f"2001-01-0{d}", "PRCP": d, "TMAX": d, "TMIN": d} for d in (1, 2, 3)]
    rows += [{"DATE": "2002-01-01", "PRCP": 10, "TMAX": 10, "TMIN": 10}]
    df = prepare_daily(daily(rows))
    got = statistics.monthly_climate(df, "2001-01-01", "2002-12-31")
    assert rows_of(got, "Month", "tmean_doy_mean", "prcp_sum") == [(1, 4.0, 120.0)]
    by_years = statistics.monthly_climate_over_years(df)
    assert rows_of(by_years, "Month", "tmean_mean", "prcp_mean") == [(1, 4.0, 8.0)]


def test_years_count_the_whole_station(daily):
    df = prepare_daily(
        daily([{"DATE": "2001-01-01", "PRCP": 3}, {"DATE": "2002-06-01"}, {"DATE": "2003-06-01"}])
    )
    got = rows_of(statistics.monthly_climate_over_years(df), "Month", "prcp_mean")
    assert got == [(1, 9.0), (6, None)]


def test_baseline_status(daily):
    df = daily(
        [
            {"STATION": "ok", "DATE": "1990-01-01"}, {"STATION": "ok", "DATE": "2011-01-01"},
            {"STATION": "short", "DATE": "1990-01-01"},
            {"STATION": "late", "DATE": "2015-01-01"},
        ]
    )
    got = rows_of(statistics.baseline_status(df), "STATION", "baseline_valid")
    assert got == [("late", False), ("ok", True), ("short", False)]
    with pytest.raises(ValueError, match="climate normals"):
        daily_climatology(df, strict=True)
    statistics.require_baseline(df.where("STATION = 'ok'"))


def test_pooled_stations_share_one_climatology(daily):
    from almanac.operators.prepare import pool_stations

    df = daily(
        [
            {"STATION": "A", "DATE": "2001-01-01", "TMAX": 1},
            {"STATION": "B", "DATE": "2001-01-01", "TMAX": 5},
        ]
    )
    clim = daily_climatology(pool_stations(df), "2001-01-01", "2001-12-31", 1, impute=False)
    assert rows_of(clim, "STATION", "tmean_doy_mean", "tmax_doy_max") == [("", 3.0, 5.0)]


def test_default_baseline():
    assert statistics.BASELINE_START == "1981-01-01"
    assert dt.date.fromisoformat(statistics.BASELINE_END) == dt.date(2010, 12, 31)


def test_trailing_mean_counts_rows_not_months(spark):
    rows = [("S", m, v) for m, v in (("2001-01", 1.0), ("2001-03", 3.0), ("2001-04", 5.0))]
    rows += [("T", "2001-01", 1.0), ("T", "2001-02", None), ("T", "2001-03", 3.0)]
    df = spark.createDataFrame(rows, "STATION string, DATE_YM string, v double")
    got = rows_of(smoothing.trailing_mean(df, "v", 2), "STATION", "DATE_YM", "trailing_values")
    assert got == [
        ("S", "2001-01", None), ("S", "2001-03", 2.0), ("S", "2001-04", 4.0),
        ("T", "2001-01", None), ("T", "2001-02", None), ("T", "2001-03", None),
    ]


def test_rows_without_station_or_day_are_in_no_group(daily):
    from almanac import daily_series

    df = daily(
        [
            {"DATE": "2001-01-01", "TMAX": 1}, {"DATE": None, "TMAX": 9},
            {"STATION": None, "DATE": "2001-01-02", "TMAX": 9},
        ]
    )
    clim = daily_climatology(df, "2001-01-01", "2001-12-31", window=1, impute=False)
    assert rows_of(clim, "STATION", "DATE_MD") == [("A", "01-01")]
    assert rows_of(statistics.date_bounds(df), "STATION", "last_date") == [("A", "2001-01-01")]
    assert rows_of(daily_series(df, clim, "2001-01-01", "2001-01-02"), "STATION", "DATE") == [
        ("A", "2001-01-01"), ("A", "2001-01-02"),
    ]


def test_baseline_checked_when_the_result_is_read(spark, daily):
    """No job before that; one station that falls short is enough."""
    full = [{"STATION": s, "DATE": f"{y}-05-01", "TMIN": 1.0} for s in "AB" for y in (1996, 2000)]
    spark.sparkContext.setJobGroup("checked", "")
    fine = daily_climatology(daily(full), "1996-01-01", "2000-01-01", window=1, impute=False, strict="on_read")
    short = daily_climatology(daily([*full, {"STATION": "C", "DATE": "1996-05-01", "TMIN": 1.0}]),
                              "1996-01-01", "2000-01-01", window=1, impute=False, strict="on_read")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("checked")
    spark.sparkContext.setJobGroup("others", "")
    assert rows_of(fine, "STATION", "tmean_doy_mean") == [("A", 1.0), ("B", 1.0)]
    with pytest.raises(Exception, match="not enough data .* at C"):
        short.collect()
