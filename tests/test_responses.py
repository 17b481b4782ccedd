"""Landed responses as a data source: names, choices, rejects, open requests."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from almanac.operators.prepare import conform_daily
from almanac.plans import backfill_plan
from almanac.sources import responses as R
from conftest import rows_of


def body(*days, **values):
    return json.dumps([{"STATION": "A", "DATE": d, "TMIN": "1.5", **values} for d in days])


GRID = [
    ("A", "1996-01-01", "1996-03-31", body("1996-01-01", "1996-02-29")),
    ("A", "1996-04-01", "1996-06-30", ""),
    ("A", "1996-07-01", "1996-09-30", None),
    ("A", "1996-10-01", "1996-12-31", '{"errorCode": 500}'),
    ("B/ü %:", "1996-01-01", "1996-03-31", body("1996-01-05")),
    ("B/ü %:", "1996-04-01", "1996-06-30", "[]"),
    ("C", "1997-01-01", "1997-12-31", "  "),
    ("C", "1998-01-01", "1998-12-31", '[{"STATION": "C", "DATE": "1998-01-01"'),
]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing"))
    df = spark.createDataFrame(GRID, "STATION string, chunk_start string, chunk_end string, body string")
    df = df.withColumns({c: F.col(c).cast("date") for c in ("chunk_start", "chunk_end")})
    R.land_responses(df.repartition(3), path)
    return path


def test_every_file_is_there_with_its_request(spark, landed):
    rows = R.read_responses(spark, landed).collect()
    got = {(r["STATION"], str(r["chunk_start"]), str(r["chunk_end"]), r["body"]) for r in rows}
    assert got == {(*g[:3], g[3] or "") for g in GRID} and len(rows) == len(GRID)
    assert all(r["size"] == len((r["body"]).encode()) for r in rows)
    names = R.read_responses(spark, landed, body=False)
    assert "body" not in names.columns and names.count() == len(GRID)


def test_choices_reach_the_source(spark, landed, monkeypatch):
    some = R.read_responses(spark, landed, stations=["A", "B/ü %:", "none"], start="1996-03-31", end="1996-04-01")
    assert rows_of(some, "STATION", "chunk_start") == [
        ("A", "1996-01-01"), ("A", "1996-04-01"), ("B/ü %:", "1996-01-01"), ("B/ü %:", "1996-04-01")]
    assert R.read_responses(spark, landed, stations=[]).count() == 0
    # What is not asked for is not listed.
    reader = R._Reader({"path": f"file://{landed}", "stations": '["A"]', "end": "1996-05-01"}, some.schema)
    listed = []
    real = R.pafs.FileSelector
    monkeypatch.setattr(R.pafs, "FileSelector", lambda p, **k: listed.append(p) or real(p, **k))
    files = [f for p in reader.partitions() for f in p.files]
    assert [(f.station, f.start) for f in files] == [("A", dt.date(1996, 1, 1)), ("A", dt.date(1996, 4, 1))]
    assert listed == [f"{landed}/A"]


def test_one_frame_in_several_places(spark, landed):
    every = R.read_responses(spark, landed)
    of_a = every.where("STATION = 'A'").select("file")
    assert (every.count(), of_a.count(), every.count()) == (8, 4, 8)
    assert of_a.union(every.where("chunk_start > '1997-06-01'").select("file")).count() == 5


def test_records_and_rejects(spark, landed):
    responses = R.read_responses(spark, landed)
    daily = conform_daily(R.response_records(responses))
    assert rows_of(daily, "STATION", "DATE", "TMIN") == [
        ("A", "1996-01-01", 1.5), ("A", "1996-01-05", 1.5), ("A", "1996-02-29", 1.5)]
    rejects = R.rejected_responses(responses)
    assert rows_of(rejects, "STATION", "chunk_start", "size") == [
        ("A", "1996-04-01", 0), ("A", "1996-07-01", 0), ("A", "1996-10-01", 18), ("C", "1997-01-01", 2), ("C", "1998-01-01", 38)]


def test_a_plan_is_asked_for_until_it_is_answered(spark, daily, tmp_path):
    """Plan, land some, plan what is open; a later answer replaces a rejected one."""
    path = str(tmp_path)
    stations = spark.createDataFrame([("A",), ("B",)], "STATION string")
    plan = backfill_plan(daily([]), stations, "1995-01-01", "1997-12-31", ["TMIN", "TMAX", "PRCP"])
    assert plan.count() == 8
    good = F.to_json(F.array(F.struct("STATION", F.col("chunk_start").cast("string").alias("DATE"), F.lit("1").alias("TMIN"))))
    first = plan.where("chunk_start < '1996-06-01'").withColumn("body", F.when(F.col("STATION") == "A", good).otherwise(""))
    R.land_responses(first, path)
    rest = R.open_requests(plan, R.read_responses(spark, path))
    n = first.where("STATION = 'A'").count()
    assert rest.count() == 8 - n and rest.columns == plan.columns
    R.land_responses(rest.withColumn("body", good), path)
    assert R.open_requests(plan, R.read_responses(spark, path)).count() == 0
    assert R.read_responses(spark, path).count() == 8


def test_other_files_and_empty_folders(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "notes.txt").write_text("x")
    (tmp_path / "A" / "_draft").write_text("x")
    (tmp_path / "loose.json").write_text("[]")
    assert R.read_responses(spark, str(tmp_path)).count() == 0
    assert R.rejected_responses(R.read_responses(spark, str(tmp_path))).count() == 0
