import pytest

from almanac import daily_climatology, daily_series, monthly_series, prepare_daily
from almanac.operators import bands, departures, records, snow

from conftest import days, rows_of


def table(daily, start="2000-01-01", n=731, **more):
    return daily(
        [
            {"DATE": d.isoformat(), "TMAX": float(d.day), "TMIN": 0.0, "PRCP": 1.0, **more}
            for d in days(start, n)
        ]
    )


def test_series_covers_the_range_and_marks_the_end_of_data(daily):
    df = table(daily, n=400)
    clim = daily_climatology(df, "2000-01-01", "2000-12-31", window=1)
    out = daily_series(df, clim, "2001-01-30", "2001-02-08", snow=False)
    got = rows_of(out, "DATE", "in_data_range", "TMEAN", "no_data_temperature")
    assert len(got) == 10
    assert got[4] == ("2001-02-03", True, 1.5, False)
    assert got[5] == ("2001-02-04", False, None, False)
    assert all(c is not None for (c,) in rows_of(out, "tmean_doy_mean"))


def test_series_gap_is_no_data(daily):
    df = table(daily, n=60).where("DATE <> '2000-01-10'")
    clim = daily_climatology(df, "2000-01-01", "2000-02-29", window=1)
    out = daily_series(df, clim, "2000-01-09", "2000-01-11", snow=False)
    assert rows_of(out, "DATE", "no_data_temperature", "no_data_precipitation") == [
        ("2000-01-09", False, False), ("2000-01-10", True, True), ("2000-01-11", False, False),
    ]


def test_series_over_new_year_has_leap_day_climate(daily):
    df = table(daily)
    clim = daily_climatology(df, "2001-01-01", "2001-12-31")
    out = daily_series(df, clim, "1999-12-30", "2000-03-01", snow=False)
    got = {d: c for d, c in rows_of(out, "DATE", "tmean_doy_mean")}
    assert len(got) == 63
    assert got["2000-02-29"] is not None


def test_series_strict_reports_days_without_climate(daily):
    df = table(daily, n=60)
    clim = daily_climatology(df, "2000-01-01", "2000-01-31", window=1)
    assert daily_series(df, clim, "2000-02-01", "2000-02-03", snow=False).count() == 3
    with pytest.raises(Exception, match="no climate for"):
        daily_series(df, clim, "2000-02-01", "2000-02-03", snow=False, strict=True).collect()


def test_snow_columns_follow_the_table(daily):
    df = table(daily, n=40)
    clim = daily_climatology(df, "2000-01-01", "2000-02-09", window=1)
    assert "snow_acc" not in daily_series(df, clim, "2000-01-01", "2000-01-02").columns
    df = table(daily, n=40, SNOW=2.0)
    clim = daily_climatology(df, "2000-01-01", "2000-02-09", window=1)
    out = daily_series(df, clim, "2000-01-05", "2000-01-06")
    assert rows_of(out, "snow_acc", "snow_acc_cm", "last_snow_date") == [
        (2.0, 0.2, "2000-01-06"), (4.0, 0.4, "2000-01-06"),
    ]


def test_last_snow_day_is_the_last_in_the_range(daily):
    rows = [{"DATE": f"2000-01-0{d}", "SNOW": s} for d, s in ((1, 1), (2, 0), (3, 5), (4, 2))]
    df = daily(rows)
    clim = daily_climatology(df, "2000-01-01", "2000-01-31", window=1)
    out = daily_series(df, clim, "2000-01-01", "2000-01-02")
    assert rows_of(out, "DATE", "last_snow_date", "until_last_snow", "from_last_snow") == [
        ("2000-01-01", "2000-01-01", True, True), ("2000-01-02", "2000-01-01", False, True),
    ]


def test_bands_treat_missing_parts_differently(spark):
    df = spark.createDataFrame(
        [(1.0, 0.5), (1.0, None), (None, None)], "tmean_doy_mean double, tmean_doy_std double"
    )
    assert [tuple(r) for r in bands.std_bands(df).select("std_hi", "std_lo").collect()] == [
        (1.5, 0.5), (1.0, None), (0.0, None),
    ]


def test_envelopes_need_both_sides(spark):
    df = spark.createDataFrame(
        [(3.0, 1.0, 2.0, 0.0), (-1.0, 1.0, 2.0, 0.0), (None, 1.0, 2.0, 0.0), (3.0, None, 0.0, None)],
        "TMEAN double, tmean_doy_mean double, std_hi double, std_lo double",
    )
    got = bands.envelopes(df).select("t_above", "t_above_std", "t_below", "t_below_std").collect()
    assert [tuple(r) for r in got] == [
        (3.0, 3.0, 1.0, 0.0), (1.0, 2.0, -1.0, -1.0), (None,) * 4, (None, 3.0, None, None),
    ]


def test_ties_are_all_records_and_missing_is_none(daily):
    df = prepare_daily(
        daily(
            [
                {"DATE": "2000-05-01", "TMAX": 9}, {"DATE": "2001-05-01", "TMAX": 9},
                {"DATE": "2002-05-01", "TMAX": 3}, {"DATE": "2003-05-01"},
                {"DATE": "2000-02-29", "TMAX": 1},
            ]
        )
    )
    extremes = records.record_extremes(df)
    got = rows_of(records.flag_records(df, extremes), "DATE", "is_record_high", "is_record_low")
    assert got == [
        ("2000-02-29", True, True), ("2000-05-01", True, False), ("2001-05-01", True, False),
        ("2002-05-01", False, True), ("2003-05-01", False, False),
    ]
    assert records.record_days(df, extremes).count() == 4


def test_records_look_at_the_whole_history(daily):
    df = daily([{"DATE": f"{y}-05-01", "TMAX": t} for y, t in ((1990, 9), (2000, 5), (2001, 7))])
    clim = daily_climatology(df, "2000-01-01", "2001-12-31", window=1)
    out = daily_series(df, clim, "2001-05-01", "2001-05-01", snow=False)
    assert rows_of(out, "is_record_high", "is_record_low") == [(False, False)]
    stored = records.record_extremes(prepare_daily(df))
    same = daily_series(df, clim, "2001-05-01", "2001-05-01", records=stored, snow=False)
    assert rows_of(same, *out.columns) == rows_of(out, *out.columns)


def test_cumulative_snowfall_skips_missing_days(daily):
    df = daily(
        [{"DATE": f"2000-01-0{d}", "SNOW": s} for d, s in ((1, 2), (2, None), (3, 3), (4, 0))]
    )
    got = rows_of(snow.snow_accumulation(df), "DATE", "snow_acc", "until_last_snow", "from_last_snow")
    assert got == [
        ("2000-01-01", 2.0, True, False), ("2000-01-02", None, True, False),
        ("2000-01-03", 5.0, True, True), ("2000-01-04", 5.0, False, True),
    ]


def test_no_snowfall_has_no_last_day(daily):
    df = daily([{"DATE": "2000-01-01", "SNOW": 0}])
    got = rows_of(snow.snow_accumulation(df), "last_snow_date", "until_last_snow", "from_last_snow")
    assert got == [(None, False, False)]


def monthly_table(daily, first_year=2000, years=3, skip=()):
    rows = []
    for y in range(first_year, first_year + years):
        for m in range(1, 13):
            if (y, m) not in skip:
                rows.append(
                    {"DATE": f"{y}-{m:02d}-15", "TMAX": m + y - first_year, "TMIN": 0.0, "PRCP": m}
                )
    return daily(rows)


def test_monthly_departures_and_classes(daily):
    df = monthly_table(daily)
    out = monthly_series(
        df, information="temperature", anomaly=True,
        baseline_start="2000-01-01", baseline_end="2002-12-31",
    )
    got = {ym: (v, c) for ym, v, c in rows_of(out, "DATE_YM", "value", "value_class")}
    assert got["2000-03"] == (-0.5, "Below average")
    assert got["2001-03"] == (0.0, "Above average")
    assert got["2002-03"] == (0.5, "Above average")
    assert "tmean_doy_mean_clim" in out.columns and "trailing_values" not in out.columns


def test_trailing_mean_is_complete_from_the_first_month_shown(daily):
    out = monthly_series(
        monthly_table(daily), start="2001-01-15", end="2002-06-30", trailing=12,
        baseline_start="2000-01-01", baseline_end="2002-12-31",
    )
    got = rows_of(out, "DATE_YM", "trailing_values")
    assert got[0][0] == "2001-01" and got[-1][0] == "2002-06"
    assert all(v is not None for _, v in got)


def test_month_missing_in_the_climate_has_no_departure(daily):
    df = monthly_table(daily, skip={(2000, 2)})
    out = monthly_series(
        df, anomaly=True, baseline_start="2000-01-01", baseline_end="2000-12-31"
    )
    got = {ym: (v, c) for ym, v, c in rows_of(out, "DATE_YM", "value", "value_class")}
    assert got["2001-02"] == (None, None)
    assert got["2001-03"][0] is not None


def test_precipitation_gate(daily):
    ok = monthly_table(daily)
    dry = monthly_table(daily, years=2).selectExpr(
        "'B' STATION", "NAME", "DATE", "CASE WHEN month(DATE) = 4 THEN NULL ELSE PRCP END PRCP",
        "SNWD", "TAVG", "TMAX", "TMIN",
    )
    both = ok.unionByName(dry)
    span = {"baseline_start": "2000-01-01", "baseline_end": "2001-12-31"}
    shown = monthly_series(both, information="Precipitation", anomaly=True, **span)
    assert {s for (s,) in rows_of(shown, "STATION")} == {"A"}
    for information, anomaly in (("Precipitation", False), ("Temperature", True)):
        shown = monthly_series(both, information=information, anomaly=anomaly, **span)
        assert {s for (s,) in rows_of(shown, "STATION")} == {"A", "B"}


def test_metric_choice():
    assert departures.choose_metric("Precipitation", False).value_column == "prcp_sum"
    assert departures.choose_metric("TEMPERATURE", True).below == "Below average"
    with pytest.raises(ValueError):
        departures.choose_metric("wind", True)


def test_short_history_is_reported_when_strict(daily):
    with pytest.raises(ValueError, match="climate normals"):
        monthly_series(monthly_table(daily), strict=True)
