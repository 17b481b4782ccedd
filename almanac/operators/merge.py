"""Bringing fetched rows into an archive: calendar padding and keep-last upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import parse_day
from almanac.operators.calendar import days_between
from almanac.operators.prepare import conform_daily
from almanac.operators.statistics import Day, between_days

KEYS = ["STATION", "DATE"]


def union_records(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def one_label(stations: DataFrame) -> DataFrame:
    """One label per station: of several the last one in the order of text. Rows without a station
    are left out."""
    return (
        stations.where(F.col("STATION").isNotNull())
        .groupBy("STATION")
        .agg(F.max("NAME").alias("NAME"))
    )


def padding_rows(stations: DataFrame, taken: DataFrame, start: Day, end: Day) -> DataFrame:
    """Empty rows for the days of the range that ``taken`` (STATION, DATE) does not have."""
    inside = between_days(taken.where(F.col("STATION").isNotNull()), start, end)
    # A set of days for each station, as many as the range has at most; copies of a day are gone
    # before the shuffle.
    days = inside.groupBy("STATION").agg(F.collect_set("DATE").alias("_taken"))
    every = days_between(F.lit(parse_day(start)), F.lit(parse_day(end)))
    none = F.array().cast("array<date>")
    missing = F.array_except(every, F.coalesce("_taken", none))
    return conform_daily(
        one_label(stations)
        .join(days, "STATION", "left")
        .select("STATION", "NAME", F.explode(missing).alias("DATE"))
    )


def pad_calendar(rows: DataFrame, stations: DataFrame, start: Day, end: Day) -> DataFrame:
    """The rows plus an empty row for every station and day of the range they lack.

    ``stations`` (STATION, NAME) gives the label of the empty rows; rows outside the range stay.
    This is the full outer join of rows and calendar, made of two parts so that the rows
    themselves are not shuffled: only their days are, as a set for each station.
    """
    rows = conform_daily(rows)
    return union_records(rows, padding_rows(stations, rows.select(*KEYS), start, end))


def keep_last(rows: DataFrame, order: str) -> DataFrame:
    """One row per station and day, the one with the highest ``order``.

    Rows of equal order are told apart by their values, so the result does not depend on how
    the data happens to be split. Spark keeps the first row of each group before the shuffle
    already (window group limit), so a day with very many copies does not end up in one task.
    """
    values = [F.col(c).desc_nulls_last() for c in rows.columns if c not in (*KEYS, order)]
    latest = Window.partitionBy(*KEYS).orderBy(F.col(order).desc_nulls_last(), *values)
    return rows.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") == 1).drop("_n")


def unique_days(rows: DataFrame) -> DataFrame:
    """One row per station and day, for tables that may hold copies."""
    return keep_last(rows.withColumn("_order", F.lit(0)), "_order").drop("_order")


def single_days(rows: DataFrame) -> DataFrame:
    """One row per station and day. Equal copies are reduced, before any shuffle; several rows of
    a day that differ, such as those of pooled stations, are an error when the rows are read:
    ``unique_days`` or a mean have to decide first. Rows without a station or a day stay."""
    values = [c for c in rows.columns if c not in KEYS]
    has_key = F.col("STATION").isNotNull() & F.col("DATE").isNotNull()
    grouped = rows.where(has_key).groupBy(*KEYS).agg(
        F.count("*").alias("_n"),
        *(F.max(c).alias(c) for c in values),
        *(F.min(c).alias(f"_low_{c}") for c in values),
        *(F.count(c).alias(f"_n_{c}") for c in values),
    )
    differ = F.lit(False)
    for c in values:
        some = (F.col(f"_n_{c}") > 0) & (F.col(f"_n_{c}") < F.col("_n"))
        differ = differ | some | ~F.col(c).eqNullSafe(F.col(f"_low_{c}"))
    text = F.concat_ws(" ", F.lit("rows that differ for"), *KEYS)
    checked = grouped.where(F.when(differ, F.raise_error(text).cast("boolean")).otherwise(True))
    return checked.select(*rows.columns).unionByName(rows.where(~has_key))


def upsert_rows(
    archive: DataFrame,
    fetched: DataFrame,
    archive_is_unique: bool = False,
    stations: DataFrame | None = None,
    order: str | None = None,
) -> DataFrame:
    """Archive and fetched rows, one per station and day; fetched rows win. Rows without a
    station or a day are left out. ``stations`` (STATION, NAME) labels the fetched rows.

    ``order`` is the column of ``fetched`` that tells which of several copies came last, such as
    the time it was fetched (``_metadata.file_modification_time``); the last one stays, and a
    missing time is the earliest. Without it, and between copies of the same time, the values
    decide: the result is the same on each run, but it need not be what came last.

    The archive is only filtered against the fetched keys. With ``archive_is_unique`` (true for
    any archive this function wrote) it is not shuffled at all when the fetched keys are small
    enough for Spark to broadcast; else its own copies are removed first.
    """
    old = _archive_rows(archive, archive_is_unique)
    new = winning_rows(fetched, stations, order)
    has_key = F.col("STATION").isNotNull() & F.col("DATE").isNotNull()
    keys = conform_daily(fetched).where(has_key).select(*KEYS).distinct()
    return union_records(old.join(keys, KEYS, "left_anti"), new)


def _archive_rows(archive: DataFrame, unique: bool) -> DataFrame:
    rows = conform_daily(archive).where(F.col("STATION").isNotNull() & F.col("DATE").isNotNull())
    return rows if unique else unique_days(rows)


def winning_rows(
    fetched: DataFrame, stations: DataFrame | None = None, order: str | None = None
) -> DataFrame:
    """The fetched rows that an upsert brings in: one per station and day, labelled. See
    ``upsert_rows`` for which of several copies that is."""
    has_key = F.col("STATION").isNotNull() & F.col("DATE").isNotNull()
    if order is None:
        new = unique_days(conform_daily(fetched).where(has_key))
    else:
        came = conform_daily(fetched.withColumn("_came", F.col(order)), keep=("_came",))
        new = keep_last(came.where(has_key), "_came").drop("_came")
    return new if stations is None else label_stations(new, stations)


#: What an upsert does to a day, in the column ``change``; null where nothing changed.
ADDED, CORRECTED, RELABELLED, PADDED = "added", "corrected", "relabelled", "padded"


def upsert_with_changes(
    archive: DataFrame,
    fetched: DataFrame,
    archive_is_unique: bool = False,
    stations: DataFrame | None = None,
    order: str | None = None,
) -> DataFrame:
    """As ``upsert_rows``, with a column ``change`` that tells what the fetched rows did to each day.

    Merging and comparing are one full outer join, so the archive is read once; it is shuffled,
    unlike in ``upsert_rows``. Give the years that the batch touches only.
    """
    old = _archive_rows(archive, archive_is_unique)
    new = winning_rows(fetched, stations, order)
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    values = [c for c in columns if c not in (*KEYS, "NAME")]

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        own = (F.col(c) if c in rows.columns else F.lit(None).cast("double") for c in columns if c not in KEYS)
        names = (f"{prefix}{c}" for c in columns if c not in KEYS)
        return rows.select(
            *KEYS, *(x.alias(n) for x, n in zip(own, names, strict=True)), F.lit(True).alias(f"{prefix}here")
        )

    both = side(old, "_old_").join(side(new, "_new_"), KEYS, "full")
    fetched_here, known = F.col("_new_here").isNotNull(), F.col("_old_here").isNotNull()
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    change = F.when(fetched_here & ~known, ADDED).when(fetched_here & ~same, CORRECTED).when(
        fetched_here & ~F.col("_old_NAME").eqNullSafe(F.col("_new_NAME")), RELABELLED
    )
    return both.select(
        *(
            F.col(c) if c in KEYS
            else F.when(fetched_here, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)
            for c in columns
        ),
        change.alias("change"),
    )


def changed_months(changed: DataFrame) -> DataFrame:
    """``(STATION, DATE_YM)``: months in which a day was added, corrected or padded. Labels are no
    part of the statistics."""
    touched = changed.where(F.col("change").isin(ADDED, CORRECTED, PADDED))
    return touched.select("STATION", F.date_format("DATE", "yyyy-MM").alias("DATE_YM")).distinct()


def label_stations(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Put the label of ``stations`` (STATION, NAME) on rows that come without one."""
    labels = one_label(stations).withColumnRenamed("NAME", "_name")
    name = F.coalesce("_name", "NAME").alias("NAME")
    return rows.join(labels, "STATION", "left").select(
        *(name if c == "NAME" else c for c in rows.columns)
    )
