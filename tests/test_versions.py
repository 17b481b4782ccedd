"""Tables published partition by partition, and an archive kept up with what is derived from it."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import merge, presence
from almanac.operators.statistics import monthly_aggregate
from almanac.plans import rebuild_months, upkeep, upsert_daily, upsert_daily_with_changes, upsert_published
from almanac.operators.prepare import prepare_daily
from almanac.sources import ConflictError, VersionedTable
from conftest import plan_of, rows_of
from test_presence import random_rows


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"), ["year", "kind"])


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, year int, kind string, value string")


def rows_in(df):
    return sorted(tuple(r) for r in df.select("id", "year", "kind", "value").collect())


FIRST = [(1, 1999, "a b", "x"), (2, 1999, "é/=", "y"), (3, 2000, "a b", None), (4, 2001, "c", "z")]


def test_only_what_is_touched_is_rewritten(spark, table):
    table.publish(frame(spark, FIRST))
    before = set(table.read().inputFiles())
    table.publish(frame(spark, [(5, 2000, "a b", "new"), (6, 2002, "c", "more")]), [(2000, "a b"), (2002, "c"), (2001, "c")])
    assert rows_in(table.read()) == [FIRST[0], FIRST[1], (5, 2000, "a b", "new"), (6, 2002, "c", "more")]
    after = set(table.read().inputFiles())
    assert len(before & after) == 2 and all("year=1999" in f for f in before & after)
    assert rows_in(table.read(1)) == FIRST and table.numbers() == [1, 2]
    assert dict(table.read().dtypes) == {"id": "bigint", "value": "string", "year": "int", "kind": "string"}
    assert "year#" in plan_of(table.read().where("year = 2000")).split("PartitionFilters")[1][:200]


def test_a_failed_write_is_not_seen(spark, table):
    table.publish(frame(spark, FIRST))
    bad = frame(spark, [(k, 1999, "a b", "x") for k in range(100)]).repartition(4).withColumn(
        "value", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("value"))
    )
    with pytest.raises(Exception, match="broken"):
        table.publish(bad, [(1999, "a b")])
    assert rows_in(table.read()) == FIRST and table.numbers() == [1]


def test_a_failed_switch_is_not_seen(spark, table, monkeypatch):
    """The data are written, the job ends before the manifest is."""
    table.publish(frame(spark, FIRST))
    reader = table.read()

    def lost(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lost)
        with pytest.raises(OSError):
            table.publish(frame(spark, [(9, 1999, "a b", "new")]), [(1999, "a b")])
    assert rows_in(table.read()) == FIRST == rows_in(reader)
    table.publish(frame(spark, [(9, 1999, "a b", "new")]), [(1999, "a b")])
    assert rows_in(table.read())[-1] == (9, 1999, "a b", "new") and rows_in(reader) == FIRST
    gone = table.forget()
    assert len(gone) == 2 and rows_in(table.read())[-1] == (9, 1999, "a b", "new") and table.numbers() == [2]


def test_two_writers(spark, table):
    table.publish(frame(spark, FIRST))
    base = table.manifest()
    table.publish(frame(spark, [(9, 2001, "c", "one")]), [(2001, "c")], base)
    with pytest.raises(ConflictError):
        table.publish(frame(spark, [(9, 2001, "c", "two")]), [(2001, "c")], base)
    assert (9, 2001, "c", "one") in rows_in(table.read())
    # Both have looked before either has written its manifest.
    base, numbers = table.manifest(), table.numbers()
    other = VersionedTable(spark, table.path, table.keys)
    table.publish(frame(spark, [(9, 2001, "c", "three")]), [(2001, "c")], base)
    other.numbers = lambda: numbers
    with pytest.raises(ConflictError):
        other.publish(frame(spark, [(9, 2001, "c", "four")]), [(2001, "c")], base)
    assert (9, 2001, "c", "three") in rows_in(table.read())


def test_what_cannot_be_published_or_read(spark, table):
    with pytest.raises(ValueError):
        table.read()
    with pytest.raises(ValueError):
        table.publish(frame(spark, FIRST), [(1999, "a b")])
    table.publish(frame(spark, []))
    assert table.read().count() == 0 and table.read().columns == ["id", "value", "year", "kind"]
    with pytest.raises(ValueError):
        table.read(7)


SPAN = ("1995-12-20", "1996-01-20")


@pytest.fixture(scope="module")
def batch(spark):
    def build(daily, seed, n=60):
        draw = random.Random(seed)
        return daily(random_rows(draw, n, first="1995-12-01", span=60))

    return build


def test_feed_tells_what_an_upsert_does(spark, daily):
    archive = daily([
        {"DATE": "1996-01-01", "TMIN": 1.0}, {"DATE": "1996-01-02", "TMIN": 2.0}, {"DATE": "1996-01-03", "TMIN": 3.0},
        {"DATE": "1996-01-05", "TMIN": None}, {"STATION": "B", "DATE": "1996-01-01", "PRCP": 0.0},
    ])
    fetched = daily([
        {"DATE": "1996-01-01", "TMIN": 1.0}, {"DATE": "1996-01-02", "TMIN": 9.0}, {"DATE": "1996-01-04", "TMIN": 4.0},
        {"DATE": "1996-01-05", "TMIN": 5.0}, {"STATION": "B", "DATE": "1996-01-01", "NAME": "other", "PRCP": 0.0},
        {"STATION": None, "DATE": "1996-01-04"}, {"DATE": None, "TMIN": 4.0},
    ])
    stations = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "STATION string, NAME string")
    merged = upsert_daily_with_changes(archive, fetched, stations, "1996-01-04", "1996-01-06")
    feed = rows_of(merged.where("change is not null"), "STATION", "DATE", "change")
    assert feed == [
        ("A", "1996-01-02", "corrected"), ("A", "1996-01-04", "added"), ("A", "1996-01-05", "corrected"), ("A", "1996-01-06", "padded"),
        ("B", "1996-01-01", "relabelled"), ("B", "1996-01-04", "padded"), ("B", "1996-01-05", "padded"), ("B", "1996-01-06", "padded"),
    ]
    plain = upsert_daily(archive, fetched, stations, "1996-01-04", "1996-01-06")
    assert rows_of(merged, *plain.columns) == rows_of(plain, *plain.columns)
    text = plan_of(merge.upsert_with_changes(archive, fetched, True))
    assert text.split("\n\n")[0].count("Join") == 1 and "FullOuter" in text


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilding_touched_months_equals_a_full_rebuild(spark, daily, batch, seed):
    archive = merge.upsert_rows(daily([], snow=True), batch(daily, seed + 10, 150))
    stations = spark.createDataFrame([(s, s) for s in "ABCD"], "STATION string, NAME string")
    merged = upsert_daily_with_changes(archive, batch(daily, seed, 25), stations, *SPAN)
    feed = merged.where("change is not null")
    before = monthly_aggregate(prepare_daily(archive))
    rebuilt = rebuild_months(before, merged, feed)
    full = monthly_aggregate(prepare_daily(merged.drop("change")))
    near = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows_of(df, *full.columns)]
    assert near(rebuilt) == near(full)


def test_archive_index_and_state_are_kept_up(spark, daily, batch, tmp_path):
    stations = spark.createDataFrame([(s, s) for s in "ABCD"], "STATION string, NAME string")
    start = merge.upsert_rows(daily([], snow=True), batch(daily, 20, 200).unionByName(
        daily([{"STATION": "A", "DATE": f"{y}-06-0{d}", "TMIN": 1.0 * d, "SNOW": None} for y in (1988, 1993) for d in (1, 2)])))
    archive = upkeep.archive_table(spark, str(tmp_path / "days"))
    index = upkeep.index_table(spark, str(tmp_path / "index"))
    state = upkeep.state_table(spark, str(tmp_path / "state"))
    upkeep.publish_archive(start, archive)
    upkeep.publish_index(start, index)
    upkeep.publish_state(start, state)
    old = set(archive.read().inputFiles())
    expected = start
    for seed in (1, 1, 2):  # the second time nothing changes
        fetched = batch(daily, seed, 40)
        feed = upsert_published(archive, fetched, stations, *SPAN, index=index, state=state)
        again = rows_of(feed, "STATION", "DATE", "change")
        merged = upsert_daily_with_changes(expected, fetched, stations, *SPAN, archive_is_unique=True)
        assert again == rows_of(merged.where("change is not null"), "STATION", "DATE", "change")
        expected = spark.createDataFrame(merged.drop("change").collect(), merged.drop("change").schema)
        now = archive.read().drop("almanac_year")
        assert rows_of(now, *expected.columns) == rows_of(expected, *expected.columns)
        want = presence.presence_index(expected)
        assert rows_of(index.read(), *want.columns) == rows_of(want, *want.columns)
        from_state = upkeep.climatology_from_state(state.read(), "1988-01-01", "1996-12-31", window=1)
        from_days = upkeep.climatology_from_state(_state_of(spark, expected, tmp_path), "1988-01-01", "1996-12-31", window=1)
        near = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows_of(df, *df.columns)]
        assert near(from_state) == near(from_days)
    kept = old & set(archive.read().inputFiles())
    assert kept and all("almanac_year=19" in f and "1995" not in f and "1996" not in f for f in kept)


def _state_of(spark, df, tmp_path):
    table = upkeep.state_table(spark, str(tmp_path / f"state-{random.random()}"))
    upkeep.publish_state(df, table)
    return table.read()
