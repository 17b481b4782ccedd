"""The presence index: which days of each station and month hold data, as one bit set each.

It has one row where the archive has up to 31, of two integers and a station. An upsert changes it
by the batch alone, so planning the next requests and reporting completeness never read the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import parse_day
from almanac.operators.gaps import days_present, gaps_between_runs, month_sets, runs_of_months
from almanac.operators.statistics import Day, keyed
from almanac.schema import measures_of

INDEX = "STATION string, month date, bits long"


def presence_index(archive: DataFrame, padded: bool = True) -> DataFrame:
    """``(STATION, month, bits)`` of a whole archive. Rows that only pad the calendar are not data."""
    return month_sets(days_present(archive, None, None, padded).where(F.col("DATE").isNotNull()))


def presence_changes(merged: DataFrame) -> DataFrame:
    """``(STATION, month, given, taken)``: days that rows brought into the archive give data, and
    days that they leave without. The rows are those that win over the archive's, one per day (of
    several copies the caller has chosen); a row without any measure takes its day's data away."""
    measures = [F.col(c) for c in measures_of(merged.columns) if c in merged.columns]
    has_data = F.coalesce(*measures).isNotNull()
    bit = F.expr("shiftleft(1L, dayofmonth(DATE) - 1)")
    return keyed(merged).groupBy("STATION", F.trunc("DATE", "month").alias("month")).agg(
        F.bit_or(F.when(has_data, bit).otherwise(F.lit(0).cast("long"))).alias("given"),
        F.bit_or(F.when(has_data, F.lit(0).cast("long")).otherwise(bit)).alias("taken"),
    )


def update_presence(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after a batch: AND-NOT of the days taken, OR of those given. One grouping of both,
    so stations and months that are new need no outer join; empty months are left out."""
    none = F.lit(0).cast("long")
    both = index.select("STATION", "month", "bits", none.alias("given"), none.alias("taken")).unionByName(
        changes.select("STATION", "month", none.alias("bits"), "given", "taken")
    )
    merged = both.groupBy("STATION", "month").agg(
        *(F.bit_or(c).alias(c) for c in ("bits", "given", "taken"))
    )
    bits = F.expr("(bits & ~taken) | given").alias("bits")
    return merged.select("STATION", "month", bits).where("bits <> 0")


def days_in_month(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month))


def range_mask(month: Column, start: Day, end: Day) -> Column:
    """The days of a month that lie in the range, as bits; none if the month lies outside."""
    first = F.greatest(F.datediff(F.lit(parse_day(start)), month), F.lit(0))
    last = F.least(F.datediff(F.lit(parse_day(end)), month) + 1, days_in_month(month))
    ones = lambda n: F.lit((1 << 31) - 1).cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)
    inside = ones(last).bitwiseAND(F.bitwise_not(ones(first)))
    return F.when((first < last) & (first < 31) & (last > 0), inside).otherwise(F.lit(0).cast("long"))


def presence_between(index: DataFrame, start: Day, end: Day) -> DataFrame:
    """The index cut to a range of days. Whole months outside are left to the scan."""
    first, last = parse_day(start), parse_day(end)
    inside = index.where(F.col("month").between(F.lit(first.replace(day=1)), F.lit(last)))
    cut = F.col("bits").bitwiseAND(range_mask(F.col("month"), first, last)).alias("bits")
    return inside.where(F.col("STATION").isNotNull()).select("STATION", "month", cut).where("bits <> 0")


def missing_ranges_of(index: DataFrame, stations: DataFrame, start: Day, end: Day) -> DataFrame:
    """As ``gaps.missing_ranges``, from the index instead of the archive."""
    runs = runs_of_months(presence_between(index, start, end))
    return gaps_between_runs(runs, stations, start, end)
