"""How complete an archive is: per month, per calendar day and per station.

All reports read sets of days per station and month (``presence.presence_index``, stored or made on
the fly), count bits and compare them with the days that the calendar has. The calendar itself is
never joined to the daily rows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import format_day_key, parse_day
from almanac.operators.presence import presence_between, range_mask
from almanac.operators.statistics import Day

#: Share of days from which a baseline is usable, over all and in each month of the year.
LEAST_SHARE = 0.8


def _months(start: Day, end: Day) -> Column:
    first, last = parse_day(start).replace(day=1), parse_day(end)
    return F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))


def _stations(stations: DataFrame) -> DataFrame:
    return stations.where(F.col("STATION").isNotNull()).select("STATION").distinct()


def longest_run(bits: Column) -> Column:
    """The longest run of ones, of a number of bits."""
    return F.array_max(F.transform(F.split(F.bin(bits), "0"), F.length))


def completeness_by_month(
    index: DataFrame, stations: DataFrame, start: Day, end: Day
) -> DataFrame:
    """Every station and month of the range: its days in the range, how many hold data, how many do
    not, the share, and the longest gap within the month. The sets of days are shuffled once."""
    if parse_day(start) > parse_day(end):
        raise ValueError("the range ends before it starts")
    every = _stations(stations).select("STATION", F.explode(_months(start, end)).alias("month"))
    rows = every.join(presence_between(index, start, end), ["STATION", "month"], "left")
    mask = range_mask(F.col("month"), start, end)
    bits = F.coalesce("bits", F.lit(0).cast("long"))
    missing = mask.bitwiseAND(F.bitwise_not(bits))
    return rows.select(
        "STATION",
        F.date_format("month", "yyyy-MM").alias("DATE_YM"),
        F.bit_count(mask).alias("n_days"),
        F.bit_count(bits).alias("n_present"),
        F.bit_count(missing).alias("n_missing"),
        (F.bit_count(bits) / F.bit_count(mask)).alias("share"),
        longest_run(missing).alias("longest_gap"),
    )


def _calendar(start: Day, end: Day) -> Column:
    """The days of the year that the range has, 366 at most, and in how many years."""
    first, n = parse_day(start), (parse_day(end) - parse_day(start)).days + 1
    days = Counter((first + dt.timedelta(days=k)).strftime("%-m%d") for k in range(n))
    return F.explode(F.from_json(F.lit(json.dumps(days)), "map<string,bigint>")).alias("_day", "n_years")


def completeness_by_day(
    index: DataFrame, stations: DataFrame, start: Day, end: Day
) -> DataFrame:
    """Every station and calendar day: in how many years the range has that day (29 February in leap
    years only), in how many of them it holds data, and the share."""
    if parse_day(start) > parse_day(end):
        raise ValueError("the range ends before it starts")
    # One counter for each day of a month: sets are counted, before any shuffle, not unpacked.
    counts = presence_between(index, start, end).groupBy("STATION", F.month("month").alias("_m")).agg(
        *(F.sum(F.getbit("bits", F.lit(d)).cast("long")).alias(f"_{d + 1}") for d in range(31))
    )
    listed = F.array(*(F.col(f"_{d + 1}") for d in range(31)))
    present = counts.select("STATION", F.posexplode(listed).alias("_d", "n_present"), "_m").select(
        "STATION", (F.col("_m") * 100 + F.col("_d") + 1).alias("_day"), "n_present"
    )
    every = _stations(stations).select("STATION", _calendar(start, end))
    rows = every.withColumn("_day", F.col("_day").cast("int")).join(present, ["STATION", "_day"], "left")
    n = F.coalesce("n_present", F.lit(0).cast("long"))
    return rows.select(
        "STATION",
        format_day_key(F.col("_day")).alias("DATE_MD"),
        "n_years",
        n.alias("n_present"),
        (n / F.col("n_years")).alias("share"),
    )


def completeness_by_station(
    index: DataFrame, stations: DataFrame, start: Day, end: Day, least: float = LEAST_SHARE
) -> DataFrame:
    """Every station: days of the range, days with data and their share, the first and last of them,
    the longest gap, the share of the poorest month of the year, and a verdict on the range as a
    baseline: ``complete``, ``usable`` (at least so large a share over all and in each month of the
    year), ``incomplete`` or ``no data``."""
    first, last = parse_day(start), parse_day(end)
    if first > last:
        raise ValueError("the range ends before it starts")
    own = presence_between(index, start, end).groupBy("STATION").agg(
        # One set for each month of the range at most.
        F.map_from_entries(F.collect_list(F.struct("month", "bits"))).alias("sets")
    )
    rows = _stations(stations).join(own, "STATION", "left")
    none = F.lit(0).cast("long")
    sets = F.transform(
        _months(start, end),
        lambda m: F.struct(
            m.alias("month"),
            range_mask(m, start, end).alias("mask"),
            F.coalesce(F.element_at("sets", m), none).alias("bits"),
        ),
    )
    rows = rows.select("STATION", sets.alias("sets"))

    def total(what, when=None) -> Column:
        return F.aggregate(
            "sets", none, lambda s, x: s + F.when(F.lit(True) if when is None else when(x), F.bit_count(what(x))).otherwise(0)
        )

    # Days in a row as text, from the first on: 1 with data. What is split off by ones are gaps.
    def days(x: Column) -> Column:
        text = F.lpad(F.bin(x["bits"]), 31, "0")
        size = F.bit_count(x["mask"])
        skipped = F.length(F.bin(x["mask"])) - size  # days before the range
        return F.substr(F.reverse(text), skipped + 1, size)

    gaps = F.split(F.array_join(F.transform("sets", days), ""), "1")
    shares = F.transform(
        F.sequence(F.lit(1), F.lit(12)),
        lambda k: total(lambda x: x["bits"], lambda x: F.month(x["month"]) == k)
        / F.nullif(total(lambda x: x["mask"], lambda x: F.month(x["month"]) == k), none),
    )
    known = F.filter("sets", lambda x: x["bits"] != 0)
    ends = rows.select(
        "STATION",
        total(lambda x: x["mask"]).alias("n_days"),
        total(lambda x: x["bits"]).alias("n_present"),
        F.array_max(F.transform(gaps, F.length)).alias("longest_gap"),
        F.array_min(F.filter(shares, lambda s: s.isNotNull())).alias("poorest_month"),
        F.when(F.size(known) > 0, F.element_at(known, 1)).alias("a"),
        F.when(F.size(known) > 0, F.element_at(known, -1)).alias("z"),
    )
    low = F.length(F.bin("a.bits")) - F.length(F.rtrim(F.bin("a.bits"), F.lit("0")))
    share = F.col("n_present") / F.col("n_days")
    verdict = (
        F.when(F.col("n_present") == F.col("n_days"), "complete")
        .when(F.col("n_present") == 0, "no data")
        .when((share >= least) & (F.col("poorest_month") >= least), "usable")
        .otherwise("incomplete")
    )
    return ends.select(
        "STATION",
        "n_days",
        "n_present",
        share.alias("share"),
        F.date_add("a.month", low).alias("first_date"),
        F.date_add("z.month", F.length(F.bin("z.bits")) - 1).alias("last_date"),
        F.col("longest_gap"),
        "poorest_month",
        verdict.alias("verdict"),
    )
