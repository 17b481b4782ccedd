"""Products against plain pandas and numpy, one station at a time, on the generated tables."""

import numpy as np
import pandas as pd
import pytest

from almanac import daily_climatology, daily_series, monthly_series
from workload import tables as t

from conftest import SF_DIR

STATS = {
    "tmean_doy_mean": ("TMEAN", "mean"),
    "tmean_doy_std": ("TMEAN", "std"),
    "tmean_doy_max": ("TMEAN", "max"),
    "tmean_doy_min": ("TMEAN", "min"),
    "tmax_doy_max": ("TMAX", "max"),
    "tmax_doy_std": ("TMAX", "std"),
    "tmin_doy_min": ("TMIN", "min"),
    "tmin_doy_std": ("TMIN", "std"),
    "snow_doy_mean": ("SNOW", "mean"),
}


def load(frame):
    frame = frame.assign(DATE=pd.to_datetime(frame["DATE"])).sort_values(["STATION", "DATE"])
    frame["TMEAN"] = np.nanmean(frame[["TMIN", "TMAX"]].to_numpy(), axis=1)
    frame["md"] = frame["DATE"].dt.strftime("%m-%d")
    return frame


def station_climatology(rows, start, end, window):
    base = rows[rows["DATE"].between(start, end) & (rows["md"] != "02-29")]
    table = base.groupby("md").agg(**STATS)
    table.loc["02-29"] = table.reindex(["02-28", "03-01"]).mean()
    table = table.sort_index()
    shifted = [np.roll(table.to_numpy(), k, axis=0) for k in range(window)]
    return pd.DataFrame(np.mean(shifted, axis=0), index=table.index, columns=table.columns)


@pytest.fixture(scope="module")
def regions(spark):
    df = t.station_daily(spark, SF_DIR, "region")
    return df, load(df.toPandas())


@pytest.fixture(scope="module")
def climatology(spark, regions):
    return daily_climatology(regions[0], *t.BASELINE).toPandas()


def same(got, want):
    np.testing.assert_allclose(
        np.asarray(got, dtype=float), np.asarray(want, dtype=float), rtol=1e-9, atol=1e-9
    )


def test_climatology(regions, climatology):
    for station, rows in regions[1].groupby("STATION"):
        want = station_climatology(rows, *t.BASELINE, t.WINDOW)
        got = climatology[climatology["STATION"] == station].set_index("DATE_MD").sort_index()
        assert list(got.index) == list(want.index)
        for c in STATS:
            same(got[c], want[c])


def test_series(regions, climatology):
    df, frame = regions
    series = daily_series(df, daily_climatology(df, *t.BASELINE), *t.WINTER).toPandas()
    calendar = pd.date_range(*t.WINTER)
    for station, rows in frame.groupby("STATION"):
        got = series[series["STATION"] == station].sort_values("DATE").reset_index(drop=True)
        climate = climatology[climatology["STATION"] == station].set_index("DATE_MD")
        climate = climate.reindex(calendar.strftime("%m-%d"))
        seen = rows.set_index("DATE").reindex(calendar)
        mean, std = climate["tmean_doy_mean"].to_numpy(), climate["tmean_doy_std"].to_numpy()
        observed = seen["TMEAN"].to_numpy()
        assert list(pd.to_datetime(got["DATE"])) == list(calendar)
        same(got["std_hi"], np.nan_to_num(mean) + np.nan_to_num(std))
        same(got["std_lo"], mean - std)
        same(got["t_above"], np.maximum(observed, mean))
        same(got["t_below_std"], np.minimum(observed, mean - std))
        same(got["snow_acc"], seen["SNOW"].cumsum())
        days = calendar.strftime("%m-%d")
        highest = rows.groupby("md")["TMEAN"].max().reindex(days).to_numpy()
        lowest = rows.groupby("md")["TMEAN"].min().reindex(days).to_numpy()
        assert list(got["is_record_high"]) == list(observed == highest)
        assert list(got["is_record_low"]) == list(observed == lowest)
        assert list(got["no_data_temperature"]) == list(np.isnan(observed))


@pytest.mark.parametrize("information, value", [("Temperature", "TMEAN"), ("Precipitation", "PRCP")])
def test_monthly_departures(regions, information, value):
    df, frame = regions
    months = monthly_series(
        df, information=information, anomaly=True, trailing=t.TRAILING,
        baseline_start=t.BASELINE[0], baseline_end=t.BASELINE[1],
    ).toPandas()
    how = {"TMEAN": "mean", "PRCP": "sum"}[value]
    for station, rows in frame.groupby("STATION"):
        rows = rows[rows["md"] != "02-29"].set_index("DATE")
        per_month = rows[value].groupby(rows.index.to_period("M")).agg(how)
        base = rows.loc[t.BASELINE[0] : t.BASELINE[1], value]
        climate = base.groupby(base.index.month).mean() * (30 if value == "PRCP" else 1)
        want = per_month - climate.reindex(per_month.index.month).to_numpy()
        got = months[months["STATION"] == station].sort_values("DATE_YM")
        assert list(got["DATE_YM"]) == [str(p) for p in per_month.index]
        same(got["value"], want)
        same(got["trailing_values"], want.rolling(t.TRAILING).mean())
        classes = np.where(want < 0, "Below average", "Above average")
        assert list(got["value_class"]) == list(classes)
