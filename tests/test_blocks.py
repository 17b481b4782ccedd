"""Mergeable climate state: blocks of years, Chan's formula, baselines."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import blocks
from almanac.operators.statistics import baseline_days, daily_statistics
from almanac.operators.prepare import prepare_daily
from almanac.plans import climatology_from_state, daily_climatology, upkeep
from conftest import plan_of

STATS = ("tmean_doy_mean", "tmean_doy_std", "tmean_doy_max", "tmean_doy_min", "tmax_doy_max", "tmax_doy_std",
         "tmin_doy_min", "tmin_doy_std", "snow_doy_mean")


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_cover_is_disjoint_aligned_and_small(levels):
    for first in range(1960, 2000, 3):
        for last in range(first - 1, first + 70, 7):
            found = blocks.cover(first, last, levels)
            years = [y for k, start in found for y in range(start, start + (1 << k))]
            assert years == list(range(first, last + 1))
            assert all(start % (1 << k) == 0 and k < levels for k, start in found)
            if levels == 6 and last - first < 32:
                assert all(sum(k == level for k, _ in found) <= 2 for level in range(levels))


def test_blocks_holding():
    assert blocks.blocks_holding([1999, 2000], 3) == [(0, 1999), (0, 2000), (1, 1998), (1, 2000), (2, 1996), (2, 2000)]


def history(draw, years=range(1990, 2003), stations="AB"):
    rows = []
    for y in years:
        for s in stations:
            for _ in range(25):
                d = dt.date(y, 1, 1) + dt.timedelta(days=draw.choice([0, 30, 58, 59, 60, 61, 200, 364]))
                low = 1e6 + draw.gauss(0, 1e-2) if draw.random() < 0.7 else None  # far from zero: a test of stability
                rows.append({"STATION": s, "DATE": d.isoformat(), "TMIN": low, "TMAX": draw.choice([None, 1e6 + draw.random()]),
                             "SNOW": draw.choice([None, 0.0, 3.5])})
    return rows


def values(df):
    return {(r["STATION"], r["DATE_MD"]): [r[c] for c in STATS] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)), (k, a[k], b[k])


SPANS = [("1990-01-01", "2002-12-31"), ("1991-02-20", "1999-03-02"), ("1995-01-01", "1995-12-31"), ("1995-02-28", "1995-03-01"),
         ("1994-06-01", "1995-03-01"), ("1980-01-01", "1989-12-31"), ("1999-01-01", "1998-01-01"), ("1996-01-01", "1996-07-20")]


def all_blocks(df, levels=blocks.LEVELS):
    sizes = [blocks.year_blocks(df)]
    for level in range(1, levels):
        sizes.append(blocks.parent_blocks(sizes[-1], level))
    out = sizes[0]
    for more in sizes[1:]:
        out = out.unionByName(more)
    return out


def test_any_baseline_equals_the_history(daily, tmp_path, spark):
    df = daily(history(random.Random(1)))
    all_blocks(df).write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    for span in SPANS:
        expected = values(daily_statistics(baseline_days(prepare_daily(df), *span)))
        same(values(blocks.statistics_from_blocks(state, *span)), expected)
    assert state.where("level = 5").count() > 0


def test_moments_merge_as_numbers_do(spark):
    draw = random.Random(2)
    parts = [[draw.gauss(1e8, 1) for _ in range(n)] for n in (0, 1, 5, 2)]
    rows = []
    for k, x in enumerate(parts):
        mean = sum(x) / len(x) if x else None
        rows.append(("A", 101, k, 0, len(x), mean, sum((v - mean) ** 2 for v in x) if x else None, min(x, default=None), max(x, default=None)))
    df = spark.createDataFrame(rows, "STATION string, _day int, first_year int, level int, TMEAN_n long, TMEAN_mean double, "
                                     "TMEAN_m2 double, TMEAN_min double, TMEAN_max double")
    (r,) = blocks.merge_blocks(df, ["STATION"]).collect()
    every = [v for x in parts for v in x]
    mean = sum(every) / len(every)
    assert (r["TMEAN_n"], r["TMEAN_min"], r["TMEAN_max"]) == (len(every), min(every), max(every))
    assert math.isclose(r["TMEAN_mean"], mean, rel_tol=1e-14)
    assert math.isclose(r["TMEAN_m2"], sum((v - mean) ** 2 for v in every), rel_tol=1e-6)


def test_stored_state_reads_few_folders_and_keeps_up(spark, daily, tmp_path):
    draw = random.Random(4)
    rows = history(draw)
    table = upkeep.state_table(spark, str(tmp_path / "state"))
    upkeep.publish_state(daily(rows), table)
    first = table.manifest()
    text = plan_of(climatology_from_state(table.read(), "1991-01-01", "2002-12-31"))
    assert "PartitionFilters: [" in text and "first_year" in text.split("PartitionFilters")[1][:400]
    read = blocks.baseline_blocks(table.read(), "1991-01-01", "2002-12-31").select("level", "first_year").distinct().collect()
    assert {tuple(r) for r in read} == {(0, 1991), (3, 1992), (1, 2000), (0, 2002)}
    # Another year, and another one corrected.
    later = [r for r in rows if r["DATE"][:4] != "1997"] + history(draw, (1997, 2003))
    new = [r for r in later if r["DATE"][:4] in ("1997", "2003")]
    upkeep.update_state(daily(new), [1997, 2003], table)
    for span in (("1990-01-01", "2003-12-31"), ("1996-03-01", "1998-02-02")):
        same(values(climatology_from_state(table.read(), *span, window=1)), values(daily_climatology(daily(later), *span, window=1)))
    second = table.manifest()
    moved = {p for p in second.folders if second.folders[p] != first.folders.get(p)}
    assert moved == {f"level={k}/first_year={y}" for k, y in blocks.blocks_holding([1997, 2003])}


def test_without_snow_and_empty(daily):
    df = daily([{"DATE": "1999-05-05", "TMIN": 1.0, "TMAX": 3.0}])
    (r,) = blocks.statistics_from_blocks(all_blocks(df, 2), "1999-01-01", "1999-12-31", 2).collect()
    assert r["tmean_doy_mean"] == 2.0 and r["tmean_doy_std"] is None and "snow_doy_mean" not in r.asDict()
    assert blocks.statistics_from_blocks(all_blocks(daily([]), 2), "1999-01-01", "1999-12-31", 2).count() == 0
    assert df.select(F.lit(1)).count() == 1


def test_state_is_made_without_tables_in_passing(spark, daily, tmp_path, monkeypatch):
    """One shuffle serves all sizes: sizes stored and shuffled one after the other take most of the time."""
    stored = []
    monkeypatch.setattr(upkeep, "scratch_path", lambda spark, name: stored.append(name) or str(tmp_path / f"{name}{len(stored)}"))
    draw = random.Random(5)
    rows = history(draw)
    table = upkeep.state_table(spark, str(tmp_path / "state"))
    upkeep.publish_state(daily(rows), table)
    later = [r for r in rows if r["DATE"][:4] not in ("1993", "2000")] + history(draw, (1993, 2000, 2010))
    upkeep.update_state(daily([r for r in later if r["DATE"][:4] in ("1993", "2000", "2010")]), [1993, 2000, 2010], table)
    assert stored == []
    # Every block of every size is the one that the history has.
    key = lambda r: (r["STATION"], r["_day"], r["level"], r["first_year"])
    moments = [f"{c}_{m}" for c in ("TMEAN", "TMAX", "TMIN", "SNOW") for m in ("n", "mean", "m2", "min", "max")]
    got, want = ({key(r): [r[c] for c in moments] for r in df.collect()} for df in (table.read(), all_blocks(daily(later))))
    assert got.keys() == want.keys()
    for k in got:
        for c, x, y in zip(moments, got[k], want[k], strict=True):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9)), (k, c, x, y)


def test_blocks_and_baselines_are_made_by_built_in_aggregates(daily, tmp_path, spark):
    table = upkeep.state_table(spark, str(tmp_path / "state"))
    upkeep.publish_state(daily(history(random.Random(6))), table)
    text = plan_of(blocks.statistics_from_blocks(table.read(), "1991-01-01", "2002-12-31"))
    assert "collect_list" not in text and "lambda" not in text
