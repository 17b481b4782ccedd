"""The presence index and the completeness reports against plain Python."""

import calendar
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import completeness, gaps, merge, presence
from almanac.plans import backfill_plan, backfill_plan_from_index
from conftest import days, plan_of, rows_of

START, END = "1995-11-17", "1996-03-05"  # holds a 29 February


def random_rows(draw, n, first="1995-10-20", span=170):
    """Rows of three stations: with data, empty ones, copies, and rows without a key."""
    rows = []
    for d in draw.choices(days(first, span), k=n):
        values = draw.choice([{"TMIN": 1.0}, {"PRCP": 0.0}, {"SNOW": 2.0}, {}, {"TMAX": 3.0, "TMIN": 1.0}])
        rows.append({"STATION": draw.choice("ABC"), "DATE": d.isoformat(), "SNOW": None, **values})
    return rows + [{"STATION": None, "DATE": first, "TMIN": 1.0}, {"STATION": "A", "DATE": None, "TMIN": 1.0}]


def present(rows):
    return {
        (r["STATION"], dt.date.fromisoformat(r["DATE"])) for r in rows
        if r["STATION"] and r["DATE"] and any(v is not None for k, v in r.items() if k not in ("STATION", "DATE", "NAME"))
    }


def days_of(index):
    out = set()
    for r in index.collect():
        for k in range(31):
            if r["bits"] >> k & 1:
                out.add((r["STATION"], r["month"] + dt.timedelta(days=k)))
    return out


def test_index_of_an_archive(daily):
    rows = random_rows(random.Random(1), 150)
    index = presence.presence_index(daily(rows))
    assert days_of(index) == present(rows)
    assert index.groupBy("STATION", "month").count().where("count > 1").count() == 0
    assert presence.presence_index(daily([], snow=True)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_batches_keep_the_index_up(daily, seed):
    """OR and AND-NOT of a batch give the index of the merged archive, batch after batch."""
    draw = random.Random(seed)
    archive = daily(random_rows(draw, 80))
    index = presence.presence_index(archive)
    for _ in range(2):
        batch = daily(random_rows(draw, 60, first="1995-12-01", span=60))
        new = merge.winning_rows(batch)
        index = presence.update_presence(index, presence.presence_changes(new))
        archive = merge.upsert_rows(archive, batch)
    expected = presence.presence_index(archive)
    assert rows_of(index, "STATION", "month", "bits") == rows_of(expected, "STATION", "month", "bits")


def test_range_masks(spark):
    months = [dt.date(1995, m, 1) for m in (10, 11, 12)] + [dt.date(1996, m, 1) for m in (1, 2, 3, 4)]
    df = spark.createDataFrame([(m,) for m in months], "month date")
    for start, end in ((START, END), ("1996-02-29", "1996-02-29"), ("1995-12-31", "1996-01-01"), ("1996-02-01", "1996-02-29")):
        low, high = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
        for r in df.select("month", presence.range_mask(F.col("month"), start, end).alias("m")).collect():
            size = calendar.monthrange(r["month"].year, r["month"].month)[1]
            inside = [low <= r["month"] + dt.timedelta(days=k) <= high for k in range(size)]
            assert r["m"] == sum(1 << k for k, x in enumerate(inside) if x)


def test_plans_from_index_and_archive_are_equal(spark, daily, tmp_path):
    rows = random_rows(random.Random(5), 160)
    archive = daily(rows)
    stations = spark.createDataFrame([("A",), ("B",), ("D",), ("A",)], "STATION string")
    presence.presence_index(archive).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    names = ("STATION", "range_start", "range_end", "chunk_start", "chunk_end")
    for start, end in ((START, END), ("1995-12-01", "1995-12-31"), ("1996-02-10", "1996-02-10"), ("1996-02-10", "1996-02-01")):
        plan = backfill_plan_from_index(index, stations, start, end, ["TMIN"] * 40)
        expected = backfill_plan(archive, stations, start, end, ["TMIN"] * 40)
        assert rows_of(plan, *names) == rows_of(expected, *names)
    text = plan_of(backfill_plan_from_index(index, stations, START, END, ["TMIN"]))
    assert "PRCP" not in text and "ReadSchema: struct<STATION:string,month:date,bits:bigint>" in text
    assert "GreaterThanOrEqual(month,1995-11-01)" in text


def longest(flags):
    best = run = 0
    for has in flags:
        run = 0 if has else run + 1
        best = max(best, run)
    return best


def all_days(start, end):
    low, high = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    return [low + dt.timedelta(days=k) for k in range((high - low).days + 1)]


SPANS = [(START, END), ("1995-11-01", "1996-02-29"), ("1996-02-29", "1996-02-29")]


@pytest.fixture(scope="module")
def reported(spark):
    return spark.createDataFrame([("A",), ("B",), ("C",), ("none",), (None,), ("A",)], "STATION string")


@pytest.mark.parametrize("span", SPANS)
def test_completeness_equals_plain_python(daily, reported, span):
    draw = random.Random(7)
    full = [{"STATION": "C", "DATE": d.isoformat(), "SNOW": None, "TMIN": 1.0} for d in days("1995-10-20", 170)]
    rows = [r for r in random_rows(draw, 200) if r["STATION"] != "C"] + full
    index, has = presence.presence_index(daily(rows)), present(rows)
    every = all_days(*span)
    months, by_day, by_station = {}, {}, {}
    for s in ("A", "B", "C", "none"):
        for d in every:
            months.setdefault((s, d.strftime("%Y-%m")), []).append((s, d) in has)
            by_day.setdefault((s, d.strftime("%m-%d")), []).append((s, d) in has)
        own = [d for d in every if (s, d) in has]
        share = len(own) / len(every)
        in_month = {}
        for d in every:
            in_month.setdefault(d.month, []).append((s, d) in has)
        poorest = min(sum(x) / len(x) for x in in_month.values())
        verdict = ("complete" if share == 1 else "no data" if not own
                   else "usable" if share >= 0.5 and poorest >= 0.5 else "incomplete")
        by_station[s] = (len(every), len(own), share, min(own, default=None), max(own, default=None),
                         longest([(s, d) in has for d in every]), poorest, verdict)
    found = completeness.completeness_by_month(index, reported, *span).collect()
    assert {tuple(r) for r in found} == {
        (*k, len(f), sum(f), len(f) - sum(f), sum(f) / len(f), longest(f)) for k, f in months.items()
    } and len(found) == len(months)
    found = completeness.completeness_by_day(index, reported, *span).collect()
    assert {tuple(r) for r in found} == {(*k, len(f), sum(f), sum(f) / len(f)) for k, f in by_day.items()}
    found = completeness.completeness_by_station(index, reported, *span, least=0.5).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == by_station and len(found) == 4


def test_completeness_over_years(daily, reported):
    """29 February is there in leap years only; a full calendar has no gap across months."""
    rows = [{"STATION": "A", "DATE": d.isoformat(), "PRCP": 0.0} for d in all_days("1995-01-01", "2000-12-31")]
    index = presence.presence_index(daily(rows))
    leap = completeness.completeness_by_day(index, reported, "1995-01-01", "2000-12-31").where("DATE_MD = '02-29'")
    assert rows_of(leap, "STATION", "n_years", "n_present")[0] == ("A", 2, 2)
    (a,) = completeness.completeness_by_station(index, reported, "1995-01-01", "2000-12-31").where("STATION = 'A'").collect()
    assert a["verdict"] == "complete" and a["longest_gap"] == 0 and a["n_days"] == 2192


def test_ranges_that_end_before_they_start(daily, reported):
    index = presence.presence_index(daily([]))
    for report in (completeness.completeness_by_month, completeness.completeness_by_day, completeness.completeness_by_station):
        with pytest.raises(ValueError):
            report(index, reported, "1996-01-02", "1996-01-01")


def test_sets_of_days_are_shuffled_once(spark, daily, reported, tmp_path):
    archive = daily(random_rows(random.Random(1), 150))
    archive.write.parquet(str(tmp_path / "days"))
    index = presence.presence_index(spark.read.parquet(str(tmp_path / "days")))
    text = plan_of(completeness.completeness_by_month(index, reported, START, END))
    shuffles = [x for x in text.split("\n") if x.startswith("Arguments: hashpartitioning(STATION") and "month" in x]
    assert len(shuffles) <= 2  # the sets, and the months of the stations
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_longest_run(spark):
    numbers = [0, 1, 2, 3, 5, 0b1110110, (1 << 31) - 1, 1 << 30]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = {r[0]: r[1] for r in df.select("n", completeness.longest_run(F.col("n"))).collect()}
    assert got == {n: max(len(x) for x in bin(n)[2:].split("0")) for n in numbers}


def test_runs_of_months(spark, daily):
    rows = random_rows(random.Random(3), 120)
    have = daily(rows).where("STATION is not null and DATE is not null")
    runs = gaps.runs_of_months(gaps.month_sets(have)).collect()
    got = {(r["STATION"], d) for r in runs for d in all_days(str(r["run_start"]), str(r["run_end"]))}
    assert got == {(r["STATION"], r["DATE"]) for r in have.collect()}
