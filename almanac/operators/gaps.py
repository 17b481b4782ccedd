"""Missing days of an archive, their contiguous ranges, and request-sized chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import parse_day
from almanac.operators.statistics import Day, between_days
from almanac.schema import measures_of

# Fixed value: rows the data service returns per request at most.
ROWS_PER_REQUEST = 1000


def days_present(
    archive: DataFrame, start: Day, end: Day, padded: bool = True
) -> DataFrame:
    """Station and day of the archive rows in the range that hold data.

    A row that only pads the calendar (no measure at all) is not data: its day is asked for
    again next time. ``padded=False`` says that there are no such rows, so that the scan reads
    the two key columns only.
    """
    rows = between_days(archive, start, end).where(F.col("STATION").isNotNull())
    if padded:
        measures = [F.col(c) for c in measures_of(archive.columns) if c in archive.columns]
        rows = rows.where(F.coalesce(*measures).isNotNull())
    return rows.select("STATION", "DATE")


def missing_days(
    archive: DataFrame, stations: DataFrame, start: Day, end: Day, padded: bool = True
) -> DataFrame:
    """Requested days the archive does not have: the days of the missing ranges."""
    ranges = missing_ranges(archive, stations, start, end, padded)
    days = F.sequence("range_start", "range_end", F.expr("interval 1 day"))
    return ranges.select("STATION", F.explode(days).alias("DATE"))


def contiguous_ranges(days: DataFrame) -> DataFrame:
    """Runs of consecutive days: first and last day of each."""
    days = days.select("STATION", "DATE").distinct()
    by_day = Window.partitionBy("STATION").orderBy("DATE")
    run = F.date_sub("DATE", F.row_number().over(by_day))
    return (
        days.select("STATION", "DATE", run.alias("_run"))
        .groupBy("STATION", "_run")
        .agg(F.min("DATE").alias("range_start"), F.max("DATE").alias("range_end"))
        .select("STATION", "range_start", "range_end", _length().alias("n_days"))
    )


def _length():
    return F.datediff("range_end", "range_start") + 1


def month_sets(days: DataFrame) -> DataFrame:
    """``(STATION, month, bits)``: the days of a month that are there, as one bit each from the first
    on. Bits are combined before the shuffle, so copies of a day vanish on the way."""
    bit = F.expr("shiftleft(1L, dayofmonth(DATE) - 1)")
    return days.groupBy("STATION", F.trunc("DATE", "month").alias("month")).agg(
        F.bit_or(bit).alias("bits")
    )


def runs_of_months(months: DataFrame) -> DataFrame:
    """Runs of consecutive days of sets of days, cut at the ends of months."""
    firsts = F.expr("bits & ~shiftleft(bits, 1)")
    lasts = F.expr("bits & ~shiftright(bits, 1)")

    def days_of(bits):
        return F.filter(F.sequence(F.lit(0), F.lit(30)), lambda d: F.getbit(bits, d) == 1)

    runs = F.arrays_zip(days_of(firsts).alias("first"), days_of(lasts).alias("last"))
    return months.where("bits <> 0").select("STATION", "month", F.inline(runs)).select(
        "STATION",
        F.date_add("month", F.col("first")).alias("run_start"),
        F.date_add("month", F.col("last")).alias("run_end"),
    )


def runs_within_months(days: DataFrame) -> DataFrame:
    """Runs of consecutive days, cut at the ends of months.

    What is shuffled and sorted later is about one row per station and month instead of one per day.
    """
    return runs_of_months(month_sets(days))


def gaps_between_runs(runs: DataFrame, stations: DataFrame, start: Day, end: Day) -> DataFrame:
    """Runs of missing days, read off as the gaps between the runs of days that are there.

    Never builds the calendar: each station
    adds the days before and after the range as sentinels, and one window compares neighbours.
    """
    wanted = stations.select("STATION").distinct()
    first, last = F.lit(parse_day(start)), F.lit(parse_day(end))
    outside = F.explode(F.array(F.date_sub(first, 1), F.date_add(last, 1)))
    sentinels = (
        wanted.where(first <= last)
        .select("STATION", outside.alias("run_start"))
        .withColumn("run_end", F.col("run_start"))
    )
    present = runs.join(wanted, "STATION", "left_semi")
    previous = F.lag("run_end").over(Window.partitionBy("STATION").orderBy("run_start"))
    return (
        present.unionByName(sentinels)
        .select("STATION", "run_start", previous.alias("_previous"))
        .where(F.datediff("run_start", "_previous") > 1)
        .select(
            "STATION",
            F.date_add("_previous", 1).alias("range_start"),
            F.date_sub("run_start", 1).alias("range_end"),
        )
        .withColumn("n_days", _length())
    )


def missing_ranges(
    archive: DataFrame, stations: DataFrame, start: Day, end: Day, padded: bool = True
) -> DataFrame:
    """Runs of days in the range that the archive does not have, for each station."""
    present = runs_within_months(days_present(archive, start, end, padded))
    return gaps_between_runs(present, stations, start, end)


def chunk_days(n_datatypes: int) -> int:
    """How many days fit into one request."""
    size = ROWS_PER_REQUEST // n_datatypes if n_datatypes > 0 else 0
    if size < 1:
        raise ValueError(f"between 1 and {ROWS_PER_REQUEST} data types are possible")
    return size


def chunk_ranges(ranges: DataFrame, n_datatypes: int) -> DataFrame:
    """Cut ranges to request size; the last chunk ends with its range."""
    size = chunk_days(n_datatypes)
    offsets = F.sequence(F.lit(0), F.col("n_days") - 1, F.lit(size))
    return ranges.select(
        "STATION", "range_start", "range_end", F.explode(offsets).alias("_offset")
    ).select(
        "STATION",
        "range_start",
        "range_end",
        F.date_add("range_start", F.col("_offset")).alias("chunk_start"),
        F.least(F.date_add("range_start", F.col("_offset") + (size - 1)), "range_end").alias(
            "chunk_end"
        ),
    )
