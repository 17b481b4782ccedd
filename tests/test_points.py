"""Nearest cells, the station registry, and ordered products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import points, registry
from almanac.operators.merge import upsert_rows
from almanac.plans import upsert_daily_with_changes
from almanac.sources import read_daily, write_daily
from almanac.sources.ordered import read_ordered, write_ordered
from conftest import SF_DIR, plan_of, rows_of
from test_presence import random_rows
from workload.queries import ON_TABLES


def km(a, b):
    la, oa, lb, ob = map(math.radians, (*a, *b))
    half = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((oa - ob) / 2) ** 2
    return 2 * points.EARTH_KM * math.asin(math.sqrt(min(1, half)))


def frame(spark, rows, key):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in rows], f"{key}, lat double, lon double")


@pytest.mark.parametrize("reach", [5.0, 120.0, 900.0, 5000.0])
def test_nearest_equals_all_pairs(spark, reach):
    draw = random.Random(int(reach))
    place = lambda: (draw.choice([draw.uniform(-90, 90), draw.uniform(85, 90), -90.0, 90.0, draw.uniform(-1, 1)]),
                     draw.choice([draw.uniform(-180, 180), draw.uniform(179.5, 180), draw.uniform(-180, -179.5), 360.0, 0.0, 180.0]))
    cells = [(i, place()) for i in range(400)]
    stations = [(f"S{i}", place()) for i in range(120)]
    stations += [(f"T{i}", (min(90, c[0] + draw.uniform(-0.03, 0.03)) if abs(c[0]) < 89 else c[0], c[1])) for i, c in cells[:40]]
    found = points.nearest_cells(frame(spark, stations, "STATION string"), frame(spark, cells, "cell long"), reach)
    got = {r["STATION"]: (r["cell"], r["distance_km"]) for r in found.collect()}
    expected = {}
    for s, p in stations:
        near = min((km(p, c), i) for i, c in cells)
        if near[0] <= reach:
            expected[s] = near
    assert got.keys() == expected.keys()
    for s, (cell, d) in got.items():
        assert math.isclose(d, expected[s][0], abs_tol=1e-5)
        assert cell == expected[s][1] or math.isclose(km(dict(stations)[s], dict(cells)[cell]), expected[s][0], abs_tol=1e-5)


def test_missing_places_and_empty_grids(spark):
    stations = spark.createDataFrame([("A", None, 1.0), ("B", 1.0, None), (None, 1.0, 1.0), ("C", 95.0, 1.0), ("D", 1.0, 1.0), ("D", 50.0, 1.0)],
                                     "STATION string, lat double, lon double")
    cells = frame(spark, [(7, (1.0, 1.1)), (7, (1.0, 1.1)), (6, (1.0, 0.9))], "cell long")
    out = points.nearest_cells(stations, cells, 100.0).collect()
    assert [(r["STATION"], r["cell"]) for r in out] == [("D", 6)]  # of two equally near
    assert points.nearest_cells(stations, cells.limit(0), 100.0).count() == 0
    with pytest.raises(ValueError):
        points.nearest_cells(stations, cells, 0)
    text = plan_of(points.nearest_cells(stations, cells, 100.0))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_bins_of_stations_are_shuffled(spark):
    # Each station becomes a row for every bin it looks into, so its table is not small any more.
    place = (F.col("id") * 10.0).alias("lat"), (F.col("id") + 0.5).alias("lon")
    stations = spark.range(9).select(F.concat(F.lit("S"), "id").alias("STATION"), *place)
    near = points.nearest_cells(stations, spark.range(9).select(F.col("id").alias("cell"), *place), 300.0)
    text = plan_of(near)
    assert "Broadcast" not in text and "SortMergeJoin" in text
    assert rows_of(near, "STATION", "cell") == [(f"S{i}", i) for i in range(9)]


def test_rows_of_few_bins_around_a_pole(spark):
    cells = [(i * 720 + k, (-90 + i / 4, k / 2)) for i in range(9) for k in range(720)]
    stations = [(f"S{i}", (-90 + draw.random() * 2, draw.uniform(-720, 720))) for draw in [random.Random(3)] for i in range(40)]
    found = points.nearest_cells(frame(spark, stations, "STATION string"), frame(spark, cells, "cell long"), 20.0)
    got = {r["STATION"]: r["distance_km"] for r in found.collect()}
    assert len(got) == len(stations)
    for s, p in stations:
        assert math.isclose(got[s], min(km(p, c) for _, c in cells), abs_tol=1e-5)


def test_cells_without_a_place_on_the_globe(spark):
    nan = float("nan")
    cells = frame(spark, [(1, (95.0, 1.0)), (2, (-90.5, 1.0)), (3, (nan, 1.0)), (4, (1e12, 1.0)), (5, (1.0, 721.0)), (6, (90.0, 7.0))], "cell long")
    stations = frame(spark, [("A", (1.0, 1.0)), ("B", (89.9, -170.0)), ("C", (nan, 1.0)), ("D", (-1e12, 1.0))], "STATION string")
    assert rows_of(points.nearest_cells(stations, cells, 100.0), "STATION", "cell") == [("A", 5), ("B", 6)]


def test_cells_serve_several_stations(spark):
    values = spark.createDataFrame([(1, "k", 2.0), (2, "k", 3.0), (3, "k", 4.0)], "cell long, key string, value double")
    matches = spark.createDataFrame([("A", 1, 0.5), ("B", 1, 0.7), ("C", 2, 0.1)], "STATION string, cell long, distance_km double")
    assert rows_of(points.extract_points(values, matches), "STATION", "key", "value") == [("A", "k", 2.0), ("B", "k", 2.0), ("C", "k", 3.0)]


def test_values_and_bins_of_an_extract_are_shuffled(spark):
    text = plan_of(ON_TABLES["point_extract"](spark, SF_DIR))
    assert "Broadcast" not in text and text.count(") SortMergeJoin") == 2


def test_registry_and_its_upkeep(spark, daily):
    draw = random.Random(2)
    archive = daily([{**r, "NAME": f"name of {r['STATION']}"} for r in random_rows(draw, 60)])
    archive = upsert_rows(daily([], snow=True), archive)
    old = registry.station_registry(archive)
    stations = spark.createDataFrame([("A", "new A"), ("D", "D"), (None, "x")], "STATION string, NAME string")
    merged = upsert_daily_with_changes(archive, daily(random_rows(draw, 30)), stations, "1996-01-01", "1996-01-05")
    new = registry.update_registry(old, merged.where("change is not null"), stations)
    expected = registry.station_registry(merged).select("STATION", "first_date", "last_date", "n_days")
    assert rows_of(new, *expected.columns) == rows_of(expected, *expected.columns)
    assert dict(rows_of(new, "STATION", "NAME")) == {"A": "new A", "B": "name of B", "C": "name of C", "D": "D"}


def test_days_of_some_stations(spark, daily, tmp_path, monkeypatch):
    rows = [{"STATION": s, "NAME": f"{s} town", "DATE": f"1996-01-0{d}", "TMIN": 1.0} for s in "ABCDE" for d in (1, 2, 3)]
    write_daily(daily(rows), str(tmp_path / "days"), clustered=True)
    days = read_daily(spark, str(tmp_path / "days"))
    stations = registry.station_registry(days)
    found = registry.stations_at(stations, "^[bd] TOWN", strict=True)
    out = registry.days_of(days, found)
    assert out.columns == days.columns
    assert rows_of(out, "STATION", "NAME", "DATE")[::3] == [("B", "B town", "1996-01-01"), ("D", "D town", "1996-01-01")]
    scan = plan_of(out).split("ReadSchema")
    assert any("In(STATION, [B,D])" in part for part in scan)
    assert all("NAME" not in part.split("\n")[0] for part in scan[1:2])
    monkeypatch.setattr(registry, "NAMED_IN_SCAN", 1)
    assert rows_of(registry.days_of(days, found), *days.columns) == rows_of(out, *days.columns)


def test_no_location_and_more_than_one(spark, daily):
    stations = registry.station_registry(daily([{"STATION": "A", "NAME": "Berlin A", "DATE": "1996-01-01"}, {"STATION": "B", "NAME": "Berlin B", "DATE": "1996-01-01"}]))
    assert registry.stations_at(stations, "berlin").count() == 2
    assert registry.stations_at(stations, "berlin a", single=True).count() == 1
    with pytest.raises(ValueError, match="more than one"):
        registry.stations_at(stations, "berlin", single=True)
    with pytest.raises(ValueError, match="no location"):
        registry.stations_at(stations, "paris", strict=True)
    assert registry.stations_at(stations, "paris").count() == 0


@pytest.mark.parametrize("files", [None, 7])
def test_files_are_in_order(spark, tmp_path, files):
    rows = spark.range(5000).select(
        (F.rand(1) * 50).cast("int").alias("a"), F.when(F.rand(2) < 0.9, F.rand(3)).alias("b"), F.col("id"))
    path = str(tmp_path / "ordered")
    write_ordered(rows, path, ["a", F.col("b").desc_nulls_first(), "id"], files)
    got = read_ordered(spark, path)
    assert got.columns == ["a", "b", "id", "place"]
    placed = [tuple(r) for r in got.orderBy("place").collect()]
    assert [r[3] for r in placed] == list(range(1, 5001))
    order = lambda r: (r[0], r[1] is not None, -(r[1] or 0), r[2])
    assert [r[:3] for r in placed] == sorted((tuple(r) for r in rows.collect()), key=order)
    names = sorted(f for f in spark.read.parquet(path).inputFiles())
    assert len(names) == (files or len(names))
    flat = [tuple(r) for f in names for r in spark.read.parquet(f).collect()]
    assert flat == [r[:3] for r in placed]  # one file after the other, without any sort


def test_order_in_csv_and_of_nothing(spark, tmp_path):
    write_ordered(spark.range(100).select((99 - F.col("id")).alias("n")), str(tmp_path / "csv"), ["n"], 4, "csv")
    text = [x for f in sorted((tmp_path / "csv").glob("part-*")) for x in f.read_text().split() if x != "n"]
    assert text == [str(i) for i in range(100)]
    write_ordered(spark.range(0), str(tmp_path / "none"), ["id"])
    assert read_ordered(spark, str(tmp_path / "none")).count() == 0
