import json

import pandas as pd
import pytest

from almanac import (
    normalize_gridded,
    normalize_long,
    read_archive,
    read_daily,
    read_pairs,
    write_csv,
    write_daily,
)
from almanac.sources import decode_records, read_service_records, rejected_bodies

from conftest import plan_of, rows_of


@pytest.fixture()
def sample(daily):
    return daily(
        [
            {"DATE": "2001-01-01", "PRCP": 1.5, "TMAX": 3, "SNOW": 2},
            {"DATE": "2001-01-02", "TMIN": -1},
        ]
    )


def test_parquet_round_trip(spark, sample, tmp_path):
    path = str(tmp_path / "daily")
    write_daily(sample, path)
    write_daily(sample, path, clustered=True)
    assert rows_of(read_daily(spark, path), *sample.columns) == rows_of(sample, *sample.columns)


def test_parquet_with_text_dates_and_saved_index(spark, tmp_path):
    frame = pd.DataFrame(
        {
            "STATION": ["A", "A", None], "NAME": "x", "PRCP": [1.0, None, None],
            "SNWD": [None] * 3, "TAVG": [None] * 3, "TMAX": [1, 2, 3], "TMIN": [0.5, 1.0, 1.5],
        },
        index=pd.Index(["2001-01-01", "2001-01-02", "2001-01-03"]),
    )
    frame["DATE"] = frame.index
    frame.index = [5, 6, 7]
    path = str(tmp_path / "a.parquet")
    frame.to_parquet(path)
    df = read_daily(spark, path)
    assert "__index_level_0__" not in df.columns
    assert rows_of(df, "DATE", "PRCP", "TMAX", "SNWD") == [
        ("2001-01-01", 1.0, 1.0, None), ("2001-01-02", None, 2.0, None), ("2001-01-03", None, 3.0, None),
    ]
    assert rows_of(read_archive(spark, path), "DATE") == [("2001-01-01",), ("2001-01-02",)]
    cut = read_daily(spark, path, start="2001-01-02", end="2001-01-02")
    assert rows_of(cut, "DATE") == [("2001-01-02",)]
    assert "GreaterThanOrEqual(DATE,2001-01-02)" in plan_of(cut)


def test_folders_per_year_are_pruned(spark, daily, tmp_path):
    df = daily([{"DATE": f"{y}-06-01", "PRCP": y} for y in range(1990, 2000)] + [{"DATE": None}])
    path = str(tmp_path / "years")
    write_daily(df, path, by_year=True)
    assert rows_of(read_daily(spark, path), *df.columns) == rows_of(df, *df.columns)
    cut = read_daily(spark, path, start="1993-06-01", end="1994-12-31")
    assert rows_of(cut, "DATE") == [("1993-06-01",), ("1994-06-01",)]
    assert "PartitionFilters: [isnotnull(almanac_year" in plan_of(cut)


@pytest.mark.parametrize("quote_all", [True, False])
def test_csv_round_trip(spark, sample, tmp_path, quote_all):
    path = str(tmp_path / "csv")
    write_csv(sample, path, quote_all)
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))
    assert ('"STATION"' in text) == quote_all
    assert rows_of(read_daily(spark, path, "csv"), *sample.columns) == rows_of(sample, *sample.columns)


def test_portal_csv_in_any_column_order(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        '"NAME","STATION","DATE","TMIN","TMAX","PRCP","TMAX_ATTRIBUTES"\n'
        '"BARROW, US","USW1","1990-01-01","-3.5","","0.0",",,W"\n'
        '"BARROW, US","USW1","1990-01-02","nan","1.0","0.3",""\n'
    )
    df = read_daily(spark, str(tmp_path / "p.csv"), "csv")
    assert rows_of(df, "DATE", "STATION", "NAME", "TMIN", "TMAX", "PRCP") == [
        ("1990-01-01", "USW1", "BARROW, US", -3.5, None, 0.0),
        ("1990-01-02", "USW1", "BARROW, US", None, 1.0, 0.3),
    ]


def test_missing_path_and_unknown_format(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_daily(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        read_daily(spark, str(tmp_path), "excel")


def test_service_responses(spark, tmp_path):
    good = [
        {"STATION": "A", "DATE": "2001-01-01", "TMAX": "1.5", "PRCP": 2},
        {"STATION": "A", "DATE": "2001-01-02", "TMIN": "-1"},
    ]
    (tmp_path / "1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "2.json").write_text("")
    (tmp_path / "3.json").write_text("[]")
    (tmp_path / "4.json").write_text("<html>too many requests</html>")
    path = str(tmp_path)
    assert rows_of(read_daily(spark, path, "json"), "DATE", "TMAX", "TMIN", "PRCP") == [
        ("2001-01-01", 1.5, None, 2.0), ("2001-01-02", None, -1.0, None),
    ]
    assert read_service_records(spark, path).count() == 2
    rejected = rejected_bodies(spark, path).collect()
    assert ["4.json" in r.file and "too many" in r.body for r in rejected] == [True]


def test_decode_bodies_in_a_column(spark):
    df = spark.createDataFrame(
        [(1, '[{"STATION":"A","DATE":"2001-01-01","TMAX":"2"}]'), (2, "oops"), (3, None), (4, "[]")],
        "request int, body string",
    )
    assert rows_of(decode_records(df), "request", "STATION", "DATE", "TMAX") == [
        (1, "A", "2001-01-01", "2")
    ]


def test_pairs_from_json_objects(spark, tmp_path):
    body = {"20010101_sst": 150.0, "20010102_sst": None, "20010102_ice": 3.0, "20010103_sst": 50.0}
    (tmp_path / "x.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "y.json").write_text("\n")
    out = normalize_gridded(read_pairs(spark, str(tmp_path), "json"), "oisst")
    assert rows_of(out, "DATE", "TMAX", "TAVG", "TMIN", "PRCP", "STATION", "NAME") == [
        ("2001-01-01", 1.5, 1.5, 1.5, None, "", ""), ("2001-01-03", 0.5, 0.5, 0.5, None, "", ""),
    ]


def test_pairs_from_lines_and_tables(spark, tmp_path):
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"20010101_sst": 1.0}\n{"20010102_sst": 2.0}\n')
    want = [("20010101_sst", 1.0), ("20010102_sst", 2.0)]
    df = read_pairs(spark, str(lines), "jsonl")
    assert rows_of(df, "key", "value") == want
    for format in ("parquet", "csv"):
        path = str(tmp_path / format)
        df.write.option("header", True).format(format).save(path)
        assert rows_of(read_pairs(spark, path, format), "key", "value") == want
    with pytest.raises(ValueError):
        read_pairs(spark, str(lines), "excel")


def test_broken_pairs_are_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"20010101_sst": 1.0')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_pairs(spark, str(tmp_path), "json").collect()


def test_reanalysis_pairs_average_copies_and_convert(spark):
    rows = [
        ("20010101_mean_2m_air_temperature", 273.15),
        ("20010101_mean_2m_air_temperature", 275.15),
        ("20010101_total_precipitation", 0.002),
        ("20010102_dewpoint_2m_temperature", 270.0),
        ("20010103_total_precipitation", None),
    ]
    df = spark.createDataFrame(rows, "key string, value double")
    got = rows_of(normalize_gridded(df, "era5"), "DATE", "TAVG", "PRCP", "TMAX")
    assert got == [("2001-01-01", pytest.approx(1.0), 2.0, None), ("2001-01-02", None, None, None)]


def test_reanalysis_of_many_points(spark):
    rows = [("P1", "20010101_total_precipitation", 1.0), ("P2", "20010101_total_precipitation", 2.0)]
    df = spark.createDataFrame(rows, "STATION string, key string, value double")
    assert rows_of(normalize_gridded(df), "STATION", "PRCP") == [("P1", 1000.0), ("P2", 2000.0)]


def test_bad_key_is_an_error(spark):
    df = spark.createDataFrame([("2001-1-1_sst", 1.0)], "key string, value double")
    with pytest.raises(Exception):
        normalize_gridded(df, "oisst").collect()


def test_long_records(spark):
    rows = [
        ("2001-01-01T00:00:00", "TMAX", 15.0), ("2001-01-01T00:00:00", "PRCP", 3.0),
        ("2001-01-03T00:00:00", "TMAX", -20.0),
    ]
    df = spark.createDataFrame(rows, "date string, datatype string, value double")
    out = normalize_long(df, ("TMAX", "PRCP"), "A", "Alpha", "2001-01-01", "2001-01-03")
    assert rows_of(out, "STATION", "NAME", "DATE", "TMAX", "PRCP") == [
        ("A", "Alpha", "2001-01-01", 1.5, 0.3), ("A", "Alpha", "2001-01-02", None, None),
        ("A", "Alpha", "2001-01-03", -2.0, None),
    ]


def test_long_records_given_twice_are_an_error(spark):
    rows = [("2001-01-01", "TMAX", 1.0), ("2001-01-01", "TMAX", None)]
    df = spark.createDataFrame(rows, "date string, datatype string, value double")
    with pytest.raises(Exception, match="more than one value of TMAX"):
        normalize_long(df, ("TMAX",), "A").collect()


def test_digit_station_ids_stay_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text("STATION,NAME,DATE,PRCP\n00123,x,2001-01-01,1\n")
    assert rows_of(read_daily(spark, str(tmp_path), "csv"), "STATION") == [("00123",)]
