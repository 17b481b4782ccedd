import random
import re

import pytest
from pyspark.sql import functions as F

from almanac import prepare_daily
from almanac.operators import inference, prepare

from conftest import rows_of


def test_date_keys(daily):
    df = prepare_daily(daily([{"DATE": "1996-02-29"}]))
    assert rows_of(df, "DATE_MD", "DATE_YM", "DATE_M") == [("02-29", "1996-02", "02")]


def test_layout_adds_and_drops_columns(spark):
    df = spark.createDataFrame(
        [("A", "2000-01-01T00:00:00", "1.5", 7)],
        "STATION string, DATE string, TMAX string, __index_level_0__ long",
    )
    out = prepare.conform_daily(df)
    assert out.columns == ["STATION", "NAME", "DATE", "PRCP", "SNWD", "TAVG", "TMAX", "TMIN"]
    assert rows_of(out, "DATE", "TMAX", "PRCP", "NAME") == [("2000-01-01", 1.5, None, None)]


def test_snow_is_kept_where_present(daily):
    assert "SNOW" in prepare_daily(daily([{"DATE": "2000-01-01", "SNOW": 1}])).columns
    assert "SNOW" not in prepare_daily(daily([{"DATE": "2000-01-01"}])).columns


def test_bad_date_is_an_error(spark):
    df = spark.createDataFrame([("A", "yesterday")], "STATION string, DATE string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        prepare_daily(df).collect()


def test_remove_feb29_keeps_rows_without_date(daily):
    df = daily([{"DATE": "2000-02-29"}, {"DATE": "2000-03-01"}, {"DATE": None}])
    got = rows_of(prepare_daily(df, remove_feb29=True), "DATE")
    assert got == [("2000-03-01",), (None,)]


def test_location(daily):
    df = daily(
        [
            {"STATION": "A", "NAME": "BERLIN-TEMPELHOF, GM", "DATE": "2000-01-01"},
            {"STATION": "B", "NAME": "Barrow, US", "DATE": "2000-01-01"},
            {"STATION": "C", "NAME": None, "DATE": "2000-01-01"},
        ]
    )
    assert rows_of(prepare_daily(df, location="berlin.*gm"), "STATION") == [("A",)]
    assert rows_of(prepare_daily(df, location="BARROW", strict=True), "STATION") == [("B",)]
    with pytest.raises(ValueError, match="station_names"):
        prepare_daily(df, location="nowhere", strict=True)
    assert rows_of(prepare.station_names(df), "NAME") == [
        ("BERLIN-TEMPELHOF, GM",), ("Barrow, US",), (None,)
    ]


def test_numeric_inference_is_all_or_nothing_and_spares_keys(spark):
    df = spark.createDataFrame(
        [("001", "1", "1e3", "x", None), ("002", "-2.5", None, "3", None)],
        "STATION string, a string, b string, c string, d string",
    )
    out = inference.assign_numeric(df)
    assert dict(out.dtypes) == {
        "STATION": "string", "a": "double", "b": "double", "c": "string", "d": "double",
    }
    assert rows_of(out, "STATION", "a", "b", "c") == [
        ("001", 1.0, 1000.0, "x"), ("002", -2.5, None, "3"),
    ]


def test_numeric_inference_rejects_what_only_java_reads_as_number(spark):
    df = spark.createDataFrame([("1d", "0x1p3")], "a string, b string")
    assert inference.numeric_profile(df).where(F.col("is_numeric")).count() == 0


def test_numbers_are_what_the_rule_says(spark):
    """Against the rule as a pattern, on texts of all kinds."""
    rule = re.compile(r"\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*")
    draw = random.Random(4)
    texts = ["".join(draw.choice("0123456789+-.eEdDfFxXinaNI \t\n") for _ in range(draw.randint(0, 6))) for _ in range(4000)]
    texts += ["1d", "1f", "0x1p3", "0x10", "1e5", "1E-5", ".5", "5.", ".", "-", "+.5e3", "nan", "NaN", "-inf", "+Infinity", "infinit", "1e999",
              "1e999f", "inff", " inf ", "\x0b7\x0c", "1 2", "1_000", "1,5", "é", "٣", "--1", "1e", "e1", "infinity1", "1inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", inference._is_number("t").alias("n")).collect()}
    wrong = {t for t in texts if got[t] != bool(rule.fullmatch(t))}
    assert not wrong, sorted(wrong)[:20]


def test_reported_average_where_both_extremes_are_missing(daily):
    rows = [{"DATE": "1996-01-01", "TAVG": 5.0}, {"DATE": "1996-01-02", "TAVG": 5.0, "TMIN": 1.0}, {"DATE": "1996-01-03"}]
    plain, average = prepare_daily(daily(rows)), prepare_daily(daily(rows), use_average=True)
    assert rows_of(plain, "DATE", "TMEAN") == [("1996-01-01", None), ("1996-01-02", 1.0), ("1996-01-03", None)]
    assert rows_of(average, "DATE", "TMEAN") == [("1996-01-01", 5.0), ("1996-01-02", 1.0), ("1996-01-03", None)]
