"""An archive, its presence index and its climate state, published together batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import parse_day
from almanac.operators.blocks import (
    BLOCK,
    LEVELS,
    blocks_holding,
    history_blocks,
    rebuilt_blocks,
    statistics_from_blocks,
    year_blocks,
)
from almanac.operators.merge import winning_rows
from almanac.operators.presence import presence_changes, presence_index, update_presence
from almanac.operators.smoothing import circular_mean, impute_feb29
from almanac.operators.statistics import Day, keyed
from almanac.plans.backfill import upsert_daily_with_changes
from almanac.sources.daily import YEAR
from almanac.sources.scratch import scratch_path
from almanac.sources.versions import VersionedTable

_STATE_ORDER = ["STATION", "_day"]


def archive_table(spark: SparkSession, path: str) -> VersionedTable:
    """Daily rows in a folder per year, ordered by station and day."""
    return VersionedTable(spark, path, [YEAR])


def index_table(spark: SparkSession, path: str) -> VersionedTable:
    """The presence index in a folder per year."""
    return VersionedTable(spark, path, [YEAR])


def state_table(spark: SparkSession, path: str) -> VersionedTable:
    """The climate state in a folder per block of years."""
    return VersionedTable(spark, path, BLOCK)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: later steps do not repeat the work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _years(df: DataFrame, date: str) -> list[int]:
    """Years that have rows: a few numbers."""
    return sorted(r[0] for r in df.select(F.year(date)).distinct().collect() if r[0] is not None)


def publish_archive(rows: DataFrame, table: VersionedTable) -> None:
    """The first version: one row per station and day."""
    table.publish(keyed(rows).withColumn(YEAR, F.year("DATE")), order=["STATION", "DATE"])


def publish_index(rows: DataFrame, table: VersionedTable) -> None:
    table.publish(presence_index(rows).withColumn(YEAR, F.year("month")), order=["STATION"])


def publish_state(df: DataFrame, table: VersionedTable, levels: int = LEVELS) -> None:
    """The state of a whole history: its rows are shuffled once for all sizes."""
    table.publish(history_blocks(df, levels), order=_STATE_ORDER, cut=True)


def update_state(year_rows: DataFrame, years: list[int], table: VersionedTable, levels: int = LEVELS) -> None:
    """Blocks of all sizes that hold the years, from the daily rows of just these years. What else
    is needed are the stored blocks next to them; the history is not read."""
    base = table.manifest()
    touched = blocks_holding(years, levels)
    new = year_blocks(year_rows)
    old = table.read(base.number) if base.schema else new.where(F.lit(False))
    table.publish(rebuilt_blocks(new, old, touched, levels), touched, base, _STATE_ORDER, cut=True)


def climatology_from_state(
    state: DataFrame, start: Day, end: Day, window: int = 7, impute: bool = True, levels: int = LEVELS
) -> DataFrame:
    """As ``daily_climatology`` of the history that the state was made of, for any baseline."""
    climatology = statistics_from_blocks(state, start, end, levels)
    if impute:
        climatology = impute_feb29(climatology)
    return circular_mean(climatology, window)


def upsert_published(
    archive: VersionedTable,
    fetched: DataFrame,
    stations: DataFrame,
    start: Day,
    end: Day,
    index: VersionedTable | None = None,
    state: VersionedTable | None = None,
    order: str | None = None,
) -> DataFrame:
    """Merge a batch into a published archive, and into its index and state if they are given.
    Only the years of the batch and of the range are read and written, and of the index and the
    state what these years touch. Gives the change feed: ``STATION``, ``DATE`` and ``change``.

    The archive is switched first, the derived tables after it. Where the job ends between, they
    are brought up by running the same batch again, which changes no value of the archive.
    """
    base = archive.manifest()
    span = range(parse_day(start).year, parse_day(end).year + 1)
    years = sorted({*span, *_years(fetched, "DATE")})
    old = archive.read(base.number).where(F.col(YEAR).isin(years)).drop(YEAR)
    merged = upsert_daily_with_changes(
        old, fetched, stations, start, end, archive_is_unique=True, order=order
    )
    merged = _kept(merged.withColumn(YEAR, F.year("DATE")), "merged")
    touched = [(y,) for y in years]
    archive.publish(merged.drop("change"), touched, base, ["STATION", "DATE"])
    if index is not None:
        before = index.manifest()
        sets = index.read(before.number).where(F.col(YEAR).isin(years)).drop(YEAR)
        sets = update_presence(sets, presence_changes(winning_rows(fetched, None, order)))
        index.publish(sets.withColumn(YEAR, F.year("month")), touched, before, ["STATION"])
    if state is not None:
        update_state(merged.drop("change", YEAR), years, state)
    return merged.where(F.col("change").isNotNull()).select("STATION", "DATE", "change")
