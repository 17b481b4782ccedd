"""Mergeable state of the daily climatology: moments by blocks of years.

For each station, calendar day and block of years the state has, of each measure, how many values
there are, their mean, the sum of squares around it, and the extremes. Blocks are aligned and double
in size: single years, pairs, fours and so on. Any baseline is a few blocks, at most two of each
size, so 30 years are read as some six rows instead of 30, and the history is never read again. A
new or corrected year changes one block of each size.

Moments are merged as by Chan's formula, which is stable: sums of squares are around their own mean.

Rows of a block are put side by side by a sort and reduced by windows, in the order they are stored
in: hardly two rows fall together on the way, so tables of groups would hold every row, made wide.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from almanac.functions import day_key, format_day_key, parse_day
from almanac.functions.dates import LEAP_DAY
from almanac.operators.prepare import ensure_prepared
from almanac.operators.statistics import Day, keyed
from almanac.schema import SNOW

#: Sizes of blocks: 1, 2, 4 and so on up to ``2 ** (LEVELS - 1)`` years.
LEVELS = 6
BLOCK = ["level", "first_year"]
_KEYS = ["STATION", "_day"]
_MOMENTS = ("n", "mean", "m2", "min", "max")


def _measures(columns) -> list[str]:
    return [c for c in ("TMEAN", "TMAX", "TMIN", SNOW) if c in columns]


def _measures_of_state(columns) -> list[str]:
    return [c[: -len("_n")] for c in columns if c.endswith("_n")]


def _parent(level: int) -> Column:
    """The first year of the block of a size that a (first) year lies in."""
    return F.col("first_year") - F.pmod("first_year", F.lit(1 << level))


def _with_block_keys(df: DataFrame) -> DataFrame:
    df = keyed(ensure_prepared(df))
    year = F.year("DATE").alias("first_year")
    return df.select("STATION", day_key(F.col("DATE")).alias("_day"), year, *_measures(df.columns))


def year_blocks(df: DataFrame) -> DataFrame:
    """The blocks of single years, from daily rows."""
    rows = _with_block_keys(df)
    stats = [
        x
        for c in _measures(rows.columns)
        for x in (
            F.count(c).alias(f"{c}_n"),
            F.avg(c).alias(f"{c}_mean"),
            (F.var_pop(c) * F.count(c)).alias(f"{c}_m2"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        )
    ]
    return rows.groupBy(*_KEYS, "first_year").agg(*stats).withColumn("level", F.lit(0))


def _together(keys: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """The rows of a key, in no order of their own, and all of them as a frame."""
    rows = Window.partitionBy(*keys).orderBy(keys[-1])
    return rows, rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _one_each(rows: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """One row for each key, with aggregates over its rows."""
    together, whole = _together(keys)
    rows = rows.withColumns({name: each.over(whole) for name, each in aggregates.items()})
    return rows.withColumn("_row", F.row_number().over(together)).where("_row = 1").drop("_row")


def _side_by_side(rows: DataFrame, upwards: Column) -> DataFrame:
    """A copy of each row for every size in ``upwards``, cut by block, station and day."""
    rows = rows.select(*(c for c in rows.columns if c not in ("level", "_least")), F.explode(upwards).alias("level"))
    first = F.expr("first_year - pmod(first_year, shiftleft(1, level))")
    return rows.withColumn("first_year", first).repartitionByRange(*BLOCK, *_KEYS)


def history_blocks(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The blocks of all sizes, from daily rows, cut by block, station and day. Every row goes to its
    block of each size as it is: that moves fewer bytes than blocks of half the size do."""
    rows = _with_block_keys(df)
    keys = [*BLOCK, *_KEYS]
    spread = _side_by_side(rows, F.sequence(F.lit(0), F.lit(levels - 1)))
    names = [f"{c}_{m}" for c in _measures(rows.columns) for m in _MOMENTS]
    found = _one_each(spread, keys, {
        f"{c}_{m}": each(c)
        for c in _measures(rows.columns)
        for m, each in zip(_MOMENTS, (F.count, F.avg, F.var_pop, F.min, F.max), strict=True)
    })
    found = found.withColumns({f"{c}_m2": F.col(f"{c}_m2") * F.col(f"{c}_n") for c in _measures(rows.columns)})
    return found.select(*_KEYS, *names, *BLOCK)


def merge_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, of all its blocks; at most two of each size come together. A block
    without values changes nothing."""
    names = _measures_of_state(blocks.columns)
    means, sums = {}, {}
    for c in names:
        n, mean, apart = F.col(f"{c}_n"), F.col(f"{c}_mean"), F.col(f"{c}_mean") - F.col(f"_{c}_mean")
        means |= {f"_{c}_n": F.sum(n), f"_{c}_total": F.sum(mean * n)}
        sums |= {
            f"_{c}_m2": F.sum(F.col(f"{c}_m2") + n * apart * apart),
            f"_{c}_min": F.min(f"{c}_min"),
            f"_{c}_max": F.max(f"{c}_max"),
        }
    _, whole = _together(keys)
    rows = blocks.withColumns({name: each.over(whole) for name, each in means.items()})
    rows = rows.withColumns({f"_{c}_mean": F.try_divide(f"_{c}_total", f"_{c}_n") for c in names})
    merged = _one_each(rows, keys, sums)
    return merged.select(*keys, *(F.col(f"_{c}_{m}").alias(f"{c}_{m}") for c in names for m in _MOMENTS))


def parent_blocks(children: DataFrame, level: int) -> DataFrame:
    """The blocks of a size, from those of half that size; all children of a block have to be there."""
    merged = merge_blocks(children.withColumn("_parent", _parent(level)), [*_KEYS, "_parent"])
    return merged.withColumnRenamed("_parent", "first_year").withColumn("level", F.lit(level))


def rebuilt_blocks(years: DataFrame, old: DataFrame, touched: Iterable[tuple[int, int]], levels: int) -> DataFrame:
    """The blocks ``touched``, from the new single years in them and the stored blocks next to those:
    what lies in a touched block without being touched. Each goes to all touched blocks it lies in."""
    parts = [years.withColumn("_least", F.lit(0))]
    for level in range(levels - 1):
        same = [y for k, y in touched if k == level]
        wanted = [y for k, y in touched if k == level + 1]
        near = (F.col("level") == level) & _parent(level + 1).isin(wanted) & ~F.col("first_year").isin(same)
        parts.append(old.where(near).withColumn("_least", F.lit(level + 1)))
    pieces = reduce(DataFrame.unionByName, parts)
    upwards = F.sequence(F.col("_least"), F.lit(levels - 1))
    return merge_blocks(_side_by_side(pieces, upwards), [*BLOCK, *_KEYS])


def cover(first: int, last: int, levels: int = LEVELS) -> list[tuple[int, int]]:
    """The fewest aligned blocks ``(level, first_year)`` that make up the years."""
    out, year = [], first
    while year <= last:
        level = 0
        while level + 1 < levels and year % (2 << level) == 0 and year + (2 << level) - 1 <= last:
            level += 1
        out.append((level, year))
        year += 1 << level
    return out


def blocks_holding(years: Iterable[int], levels: int = LEVELS) -> list[tuple[int, int]]:
    """All blocks that any of the years is in."""
    return sorted({(k, y - y % (1 << k)) for y in years for k in range(levels)})


def _any(blocks: list[tuple[int, int]]) -> Column:
    """A filter of whole blocks, by which folders of a stored state are chosen."""
    each = ((F.col("level") == k) & (F.col("first_year") == y) for k, y in blocks)
    return reduce(lambda a, b: a | b, each, F.lit(False))


def baseline_blocks(state: DataFrame, start: Day, end: Day, levels: int = LEVELS) -> DataFrame:
    """The rows of the state that make up a baseline: large blocks, and of a first or last year that
    is not whole the days inside. 29 February is never in a baseline."""
    first, last = parse_day(start), parse_day(end)
    key = lambda d: d.month * 100 + d.day
    whole = range(first.year + (key(first) > 101), last.year + (key(last) == 1231))
    chosen = _any(cover(whole.start, whole.stop - 1, levels))
    for year in {first.year, last.year} - set(whole):
        inside = F.lit(True)
        if year == first.year:
            inside = inside & (F.col("_day") >= key(first))
        if year == last.year:
            inside = inside & (F.col("_day") <= key(last))
        chosen = chosen | (_any([(0, year)]) & inside)
    if first > last:
        chosen = F.lit(False)
    return state.where(chosen & (F.col("_day") != LEAP_DAY))


def statistics_from_blocks(state: DataFrame, start: Day, end: Day, levels: int = LEVELS) -> DataFrame:
    """As ``statistics.daily_statistics`` of the baseline's days."""
    # By station, as the steps that follow need them: a station has some blocks of 366 days.
    rows = merge_blocks(baseline_blocks(state, start, end, levels).repartition("STATION"), _KEYS)
    std = lambda c: F.when(F.col(f"{c}_n") > 1, F.sqrt(F.col(f"{c}_m2") / (F.col(f"{c}_n") - 1)))
    stats = [
        F.col("TMEAN_mean").alias("tmean_doy_mean"),
        std("TMEAN").alias("tmean_doy_std"),
        F.col("TMEAN_max").alias("tmean_doy_max"),
        F.col("TMEAN_min").alias("tmean_doy_min"),
        F.col("TMAX_max").alias("tmax_doy_max"),
        std("TMAX").alias("tmax_doy_std"),
        F.col("TMIN_min").alias("tmin_doy_min"),
        std("TMIN").alias("tmin_doy_std"),
    ]
    if f"{SNOW}_mean" in rows.columns:
        stats.append(F.col(f"{SNOW}_mean").alias("snow_doy_mean"))
    return rows.select("STATION", format_day_key(F.col("_day")).alias("DATE_MD"), *stats)
