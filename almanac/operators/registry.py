"""The registry of stations: a row for each, which names and places are looked up in.

The label pattern then meets a row per station instead of one per day, and the daily rows are read
by station: their file statistics leave out what other stations have, and the label is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.merge import one_label
from almanac.operators.prepare import location_matches
from almanac.operators.statistics import keyed

#: So many stations are named in the scan itself; more are joined.
NAMED_IN_SCAN = 1_000


def station_registry(daily: DataFrame) -> DataFrame:
    """``(STATION, NAME, first_date, last_date, n_days)``: the label (of several the last in the order
    of text), the first and last day, and the number of rows. To be stored with the archive."""
    return (
        keyed(daily)
        .groupBy("STATION")
        .agg(
            F.max("NAME").alias("NAME"),
            F.min("DATE").alias("first_date"),
            F.max("DATE").alias("last_date"),
            F.count("*").alias("n_days"),
        )
    )


def update_registry(registry: DataFrame, changes: DataFrame, stations: DataFrame) -> DataFrame:
    """The registry after an upsert, from its change feed (``STATION``, ``DATE``, ``change``) and the
    labels of the stations: days added or padded extend it, a listed label replaces the old one."""
    fresh = changes.where(F.col("change").isin("added", "padded")).groupBy("STATION").agg(
        F.min("DATE").alias("first_date"), F.max("DATE").alias("last_date"), F.count("*").alias("n_days")
    )
    none = F.lit(None).cast("string").alias("NAME")
    both = registry.select("STATION", "NAME", "first_date", "last_date", "n_days").unionByName(
        fresh.select("STATION", none, "first_date", "last_date", "n_days")
    )
    merged = both.groupBy("STATION").agg(
        F.max("NAME").alias("_old"), F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"), F.sum("n_days").alias("n_days"),
    )
    named = merged.join(one_label(stations), "STATION", "left")
    name = F.coalesce("NAME", "_old").alias("NAME")
    return named.select("STATION", name, "first_date", "last_date", "n_days")


def stations_at(
    registry: DataFrame, location: str, strict: bool = False, single: bool = False
) -> DataFrame:
    """The stations whose label matches a pattern. ``strict`` makes it an error if none does, and
    ``single`` if they have more than one label; both look at the registry only."""
    found = registry.where(location_matches(location))
    if strict or single:
        labels = [r[0] for r in found.select("NAME").distinct().limit(3).collect()]
        if not labels:
            raise ValueError(f"no location matches {location!r}; the registry lists those there are")
        if single and len(labels) > 1:
            raise ValueError(f"more than one location matches {location!r}: {labels[0]!r}, {labels[1]!r} and so on")
    return found


def days_of(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """The daily rows of some stations, labelled from ``stations`` (a part of the registry).

    The label in the rows is not read. Up to ``NAMED_IN_SCAN`` stations become a condition of the
    scan (this looks at the registry), which skips the row groups of others where the archive is
    ordered by station; more are a semi-join, in which Spark filters at run time.
    """
    some = [r[0] for r in stations.select("STATION").distinct().limit(NAMED_IN_SCAN + 1).collect()]
    rows = daily.drop("NAME")
    if len(some) <= NAMED_IN_SCAN:
        rows = rows.where(F.col("STATION").isin(some))
    labelled = rows.join(one_label(stations), "STATION")
    return labelled.select(*daily.columns)
