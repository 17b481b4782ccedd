"""The registered queries: the library applied to the derived station tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac import (
    backfill_plan,
    backfill_plan_from_index,
    climatology_from_state,
    daily_climatology,
    daily_series,
    monthly_series,
    normalize_gridded,
    normalize_long,
    prepare_daily,
    read_daily,
    read_pairs,
    rebuild_months,
    upsert_daily,
    upsert_daily_with_changes,
    upsert_published,
    write_csv,
    write_daily,
)
from almanac.operators import bands, calendar, completeness, departures, gaps, inference, merge
from almanac.operators import points, prepare, presence, records, registry, reshape, smoothing, snow
from almanac.operators import statistics
from almanac.plans import upkeep
from almanac.sources import decode_records, json_value, read_service_records, rejected_bodies
from almanac.sources import responses
from almanac.sources.ordered import read_ordered, write_ordered
from almanac.sources.scratch import scratch_path
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
OnDaily = Callable[[DataFrame], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 places, so that the order of additions does not show; no negative zero."""
    return df.select(
        *(
            (F.round(f.name, 9) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def _climatology(daily: DataFrame, window: int = t.WINDOW) -> DataFrame:
    return daily_climatology(daily, *t.BASELINE, window=window)


def _series(daily: DataFrame, span: tuple[str, str]) -> DataFrame:
    return daily_series(daily, _climatology(daily), *span, days_are_unique=True)


def _monthly(information: str, anomaly: bool) -> OnDaily:
    return lambda daily: monthly_series(
        daily,
        start=t.YEAR[0],
        end="2001-08-31",
        information=information,
        anomaly=anomaly,
        trailing=t.TRAILING,
        baseline_start=t.BASELINE[0],
        baseline_end=t.BASELINE[1],
    )


# Queries on the daily table of one level: raw rows come in, tables go out.


def prepare_daily_table(daily):
    return prepare_daily(daily)


def remove_feb29(daily):
    return prepare_daily(daily, remove_feb29=True).select("STATION", "DATE", "DATE_MD", "TMEAN")


def location_filter(daily):
    return prepare_daily(daily, location="Nation_1.*asia").select("STATION", "NAME", "DATE", "TMEAN")


def station_names(daily):
    return prepare.station_names(daily).withColumn("matches", prepare.location_matches("asia"))


def numeric_cast(daily):
    text = daily.select(*(F.col(c).cast("string").alias(c) for c in daily.columns))
    return prepare.conform_daily(inference.assign_numeric(text))


def date_bounds(daily):
    return statistics.baseline_status(daily, t.STATUS_END)


def baseline_rows(daily):
    rows = statistics.baseline_days(prepare_daily(daily), *t.BASELINE)
    return rows.select("STATION", "DATE", "PRCP", "TMEAN")


def daily_climatology_raw(daily):
    return daily_climatology(daily, *t.BASELINE, window=1, impute=False)


def daily_climatology_feb29(daily):
    return daily_climatology(daily, *t.BASELINE, window=1)


def daily_climatology_smooth(daily):
    return _climatology(daily)


def daily_climatology_even_window(daily):
    return _climatology(daily, window=6)


def daily_climatology_checked(daily):
    """The check of the baseline is part of the job that reads the result."""
    return daily_climatology(daily, *t.BASELINE, window=t.WINDOW, strict="on_read")


def daily_climatology_pooled(daily):
    return _climatology(prepare.pool_stations(daily))


def observed_vs_climate(daily):
    daily = prepare_daily(daily)
    spine = calendar.station_calendar(statistics.date_bounds(daily), *t.YEAR)
    observed = daily.select("STATION", "DATE", "PRCP", "TMEAN")
    joined = calendar.join_observations(calendar.with_day_key(spine), observed)
    mean = _climatology(daily).select("STATION", "DATE_MD", "tmean_doy_mean", "tmean_doy_std")
    return calendar.no_data_flags(calendar.join_climatology(joined, mean)).drop("_day")


def std_bands(daily):
    return bands.std_bands(_climatology(daily)).select(
        "STATION", "DATE_MD", "tmean_doy_mean", "tmean_doy_std", "std_hi", "std_lo"
    )


def envelopes(daily):
    climate = bands.std_bands(_climatology(daily)).drop("snow_doy_mean")
    observed = prepare_daily(daily).select("STATION", "DATE", "DATE_MD", "TMEAN")
    joined = calendar.join_climatology(observed, climate)
    return bands.envelopes(joined).select(
        "STATION", "DATE", "TMEAN", "t_above", "t_above_std", "t_below", "t_below_std"
    )


def record_extremes(daily):
    return records.record_extremes(prepare_daily(daily))


def record_days(daily):
    daily = prepare_daily(daily)
    observed = statistics.between_days(daily, *t.YEAR).select("STATION", "DATE", "DATE_MD", "TMEAN")
    return records.record_days(observed, records.extremes_by_day(daily))


def snow_accumulation(daily):
    rows = statistics.between_days(daily, *t.WINTER).select("STATION", "DATE", "SNOW")
    return snow.snow_accumulation(rows, days_are_unique=True)


def monthly_stats(daily):
    return statistics.monthly_aggregate(prepare_daily(daily), end="2001-08-31")


def monthly_stats_zero_sum(daily):
    emptied = daily.withColumn("PRCP", F.when(F.col("SNOW").isNull(), F.col("PRCP")))
    return statistics.monthly_statistics(prepare_daily(emptied), empty_sum=0)


def monthly_climate(daily):
    return statistics.monthly_climate(prepare_daily(daily), *t.BASELINE)


def monthly_climate_years(daily):
    return statistics.monthly_climate_over_years(prepare_daily(daily))


def monthly_anomaly(daily):
    daily = prepare_daily(daily)
    monthly = departures.with_month_parts(statistics.monthly_aggregate(daily))
    climate = statistics.monthly_climate(daily, *t.BASELINE)
    return departures.departures(departures.join_month_climate(monthly, climate)).select(
        "STATION", "DATE_YM", "DATE", "Month", "Year", "tmean_diff", "prcp_diff"
    )


def precipitation_gate(daily):
    """Winter months of some stations have no precipitation value left."""
    emptied = daily.withColumn(
        "PRCP",
        F.when(~((F.month("DATE") == 1) & F.col("NAME").rlike("NATION_1|ASIA")), F.col("PRCP")),
    )
    return _monthly("Precipitation", True)(emptied).select("STATION", "DATE_YM", "value")


def monthly_trailing(daily):
    monthly = statistics.monthly_aggregate(prepare_daily(daily))
    return smoothing.trailing_mean(monthly, "tmean_doy_mean", t.TRAILING).select(
        "STATION", "DATE_YM", "tmean_doy_mean", "trailing_values"
    )


def missing_days(daily):
    everyone = daily.select("STATION").distinct()
    return gaps.missing_days(t.archive(daily), everyone, *t.YEAR)


def missing_ranges(daily):
    return gaps.missing_ranges(t.archive(daily), daily.select("STATION"), *t.YEAR)


def contiguous_ranges(daily):
    return gaps.contiguous_ranges(daily.select("STATION", "DATE"))


def backfill_chunks(daily):
    return backfill_plan(
        t.archive(daily), daily.select("STATION"), "1990-01-01", "2001-12-31", t.DATATYPES
    )


def completeness_months(daily):
    index = presence.presence_index(t.archive(daily))
    return completeness.completeness_by_month(index, daily, *t.REPORT)


def completeness_days(daily):
    index = presence.presence_index(t.archive(daily))
    return completeness.completeness_by_day(index, daily, *t.REPORT)


def completeness_stations(daily):
    index = presence.presence_index(t.archive(daily))
    return completeness.completeness_by_station(index, daily, *t.REPORT, least=t.LEAST_SHARE)


def _index_after_upsert(daily):
    """Kept up from the batch alone."""
    changes = presence.presence_changes(merge.winning_rows(t.emptied(t.fetched(daily))))
    return presence.update_presence(presence.presence_index(t.archive(daily)), changes)


def presence_after_upsert(daily):
    return _index_after_upsert(daily)


def backfill_from_index(daily):
    return backfill_plan_from_index(
        _index_after_upsert(daily), daily.select("STATION"), "1990-01-01", "2001-12-31", t.DATATYPES
    )


def _with_changes(daily):
    everyone = daily.select("STATION", "NAME").distinct()
    return upsert_daily_with_changes(
        t.archive(daily), t.emptied(t.fetched(daily)), everyone, *t.YEAR, archive_is_unique=True
    )


def upsert_changes(daily):
    return _with_changes(daily).where("change is not null").select("STATION", "DATE", "change")


def months_rebuilt(daily):
    """The months that the changes touch are made anew, those of the archive stay."""
    merged = _with_changes(daily)
    before = statistics.monthly_aggregate(prepare_daily(t.archive(daily)))
    return rebuild_months(before, merged, merged.where("change is not null"))


def _published(daily, *derived):
    """The archive and tables derived from it, published, then a batch."""
    spark, path = daily.sparkSession, scratch_path(daily.sparkSession, "published")
    archive = upkeep.archive_table(spark, f"{path}/days")
    upkeep.publish_archive(t.archive(daily), archive)
    made = {}
    for name, table, publish in (
        ("index", upkeep.index_table, upkeep.publish_index),
        ("state", upkeep.state_table, upkeep.publish_state),
    ):
        if name in derived:
            made[name] = table(spark, f"{path}/{name}")
            publish(t.archive(daily), made[name])
    everyone = daily.select("STATION", "NAME").distinct()
    upsert_published(archive, t.fetched(daily), everyone, *t.YEAR, **made)
    return archive if not derived else made[derived[0]]


def archive_published(daily):
    return _published(daily).read().drop("almanac_year")


def index_published(daily):
    return _published(daily, "index").read().drop("almanac_year")


def climatology_published(daily):
    """Over a baseline that holds the year of the batch."""
    return climatology_from_state(_published(daily, "state").read(), *t.LONG_BASELINE, window=t.WINDOW)


def _from_state(span):
    def query(daily):
        spark = daily.sparkSession
        table = upkeep.state_table(spark, scratch_path(spark, "state"))
        upkeep.publish_state(daily, table)
        return climatology_from_state(table.read(), *span, window=t.WINDOW)

    return query


def pad_calendar(daily):
    everyone = daily.select("STATION", "NAME").distinct()
    return merge.pad_calendar(t.archive(daily), everyone, *t.YEAR)


def upsert_keep_last(daily):
    return merge.upsert_rows(t.archive(daily), t.fetched(daily))


def upsert_padded(daily):
    everyone = daily.select("STATION", "NAME").distinct()
    return upsert_daily(
        t.archive(daily), t.fetched(daily), everyone, *t.YEAR, archive_is_unique=True
    )


def service_records(daily):
    return prepare.conform_daily(decode_records(t.service_bodies(daily)))


def long_pivot_scaled(daily):
    return normalize_long(t.long_records(daily), t.DATATYPES)


def long_pivot_padded(daily):
    return normalize_long(t.long_records(daily), t.DATATYPES, None, "label", *t.YEAR)


def csv_roundtrip(daily):
    spark = daily.sparkSession
    path = scratch_path(spark, "daily-csv")
    write_csv(daily, path, quote_all=True)
    return read_daily(spark, path, format="csv")


def parquet_roundtrip(daily):
    spark = daily.sparkSession
    path = scratch_path(spark, "daily-parquet")
    write_daily(daily, path, clustered=True)
    return read_daily(spark, path, start=t.BASELINE[0], end=t.BASELINE[1])


def _two_kinds(daily):
    """Odd months without snow and with dates as text, even ones with snow, in another order."""
    even = F.month("DATE") % 2 == 0
    text = F.col("DATE").cast("string").alias("DATE")
    odd = daily.where(~even).select("STATION", "NAME", text, "PRCP", "SNWD", "TAVG", "TMAX", "TMIN")
    return odd, daily.where(even).select("TMIN", "SNOW", "TMAX", "TAVG", "SNWD", "PRCP", "DATE", "NAME", "STATION")


def mixed_parquet(daily):
    spark = daily.sparkSession
    path = scratch_path(spark, "mixed-parquet")
    for part in _two_kinds(daily):
        part.write.mode("append").parquet(path)
    return read_daily(spark, path)


def mixed_csv(daily):
    spark = daily.sparkSession
    path = scratch_path(spark, "mixed-csv")
    for part in _two_kinds(daily):
        part.write.mode("append").option("header", True).csv(path)
    return read_daily(spark, path, "csv")


def text_dates_in_range(daily):
    """Every tenth day is written without leading zeros."""
    spark = daily.sparkSession
    path = scratch_path(spark, "text-dates")
    short = F.date_format("DATE", "yyyy-M-d")
    text = F.when(F.dayofyear("DATE") % 10 == 0, short).otherwise(F.col("DATE").cast("string"))
    daily.withColumn("DATE", text).write.parquet(path)
    return read_daily(spark, path, start=t.BASELINE[0], end=t.BASELINE[1])


def upsert_newest(daily):
    """Each fetched row is followed by a correction downwards."""
    first = t.fetched(daily).withColumn("came", F.lit(1))
    then = first.withColumns({"came": F.lit(2), "PRCP": F.col("PRCP") - 1})
    return merge.upsert_rows(t.archive(daily), then.unionByName(first), order="came")


def upsert_relabelled(daily):
    """The labels of the stations have changed; the old ones are still listed."""
    old = daily.select("STATION", "NAME").distinct()
    new = old.withColumn("NAME", F.concat(F.lit("zz "), "NAME"))
    undated = t.fetched(daily).withColumn("DATE", F.lit(None).cast("date"))
    return upsert_daily(
        t.archive(daily), t.fetched(daily).unionByName(undated), old.unionByName(new), *t.YEAR
    )


def _landed(daily):
    path = scratch_path(daily.sparkSession, "landed")
    t.write_bodies(t.service_bodies(daily).unionByName(t.rejected(daily)), path)
    return path


def landed_records(daily):
    return prepare.conform_daily(read_service_records(daily.sparkSession, _landed(daily)))


def landed_rejects(daily):
    return rejected_bodies(daily.sparkSession, _landed(daily)).select(
        F.regexp_replace("body", "\n$", "").alias("body")
    )


def _responses(daily, **chosen):
    path = scratch_path(daily.sparkSession, "responses")
    responses.land_responses(t.responses(daily), path)
    return responses.read_responses(daily.sparkSession, path, **chosen)


def responses_in_range(daily):
    """Only the files of the year are opened."""
    found = _responses(daily, start=t.YEAR[0], end=t.YEAR[1])
    return prepare.conform_daily(responses.response_records(found))


def responses_rejected(daily):
    """Files of zero bytes are among them."""
    found = responses.rejected_responses(_responses(daily))
    return found.select("STATION", "chunk_start", "chunk_end", "size")


def requests_open(daily):
    """What is left of a plan of requests for each year and station, one year more than asked for."""
    asked = t.responses(daily).select("STATION", "chunk_start", "chunk_end")
    later = daily.select(
        "STATION", F.lit("2002-01-01").cast("date").alias("chunk_start"),
        F.lit("2002-12-31").cast("date").alias("chunk_end"),
    ).distinct()
    return responses.open_requests(asked.unionByName(later), _responses(daily))


def registry_of_stations(daily):
    return registry.station_registry(daily)


def registry_after_upsert(daily):
    """Kept up from the change feed and the labels alone."""
    old = registry.station_registry(t.archive(daily))
    feed = _with_changes(daily).where("change is not null")
    labels = daily.select("STATION", F.concat(F.lit("zz "), "NAME").alias("NAME")).distinct()
    return registry.update_registry(old, feed, labels)


def location_by_registry(daily):
    """The days of an archive ordered by station, without reading its labels."""
    spark, path = daily.sparkSession, scratch_path(daily.sparkSession, "registered")
    write_daily(daily, f"{path}/days", clustered=True)
    registry.station_registry(daily).write.parquet(f"{path}/stations")
    found = registry.stations_at(spark.read.parquet(f"{path}/stations"), "Nation_1.*asia")
    return prepare_daily(registry.days_of(read_daily(spark, f"{path}/days"), found)).select(
        "STATION", "NAME", "DATE", "TMEAN"
    )


def climatology_in_order(daily):
    """As a product whose files are in order; each row has its place."""
    path = scratch_path(daily.sparkSession, "ordered")
    climatology = _climatology(daily).select("STATION", "DATE_MD", "tmean_doy_mean")
    write_ordered(climatology, path, ["STATION", "DATE_MD"])
    return read_ordered(daily.sparkSession, path)


# Queries on other tables.


def nearest_cells(spark, sf_dir):
    found = points.nearest_cells(t.places(spark, sf_dir), t.grid_cells(spark, sf_dir), t.REACH_KM)
    return found.select("STATION", "cell", F.round("distance_km", 6).alias("distance_km"))


def point_extract(spark, sf_dir):
    """The daily rows of each station's nearest cell."""
    near = points.nearest_cells(t.places(spark, sf_dir), t.grid_cells(spark, sf_dir), t.REACH_KM)
    names = F.create_map(*(F.lit(x) for pair in t.ERA5_FEATURES.items() for x in pair))
    values = t.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cell"),
        F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), names[F.col("event_type")]).alias("key"),
        "value",
    )
    return rounded(normalize_gridded(points.extract_points(values, near), "era5"))


def landing_json(spark, sf_dir):
    """Sums of a field of the JSON text of the events."""
    k = json_value("props", "k", "bigint")
    return (
        t.table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count(k).alias("n_values"), F.sum(k).alias("total"))
    )


def numeric_inference(spark, sf_dir):
    return inference.numeric_profile(t.text_lines(spark, sf_dir))


def landed_pairs(spark, sf_dir):
    """Events as extracts of a grid point, a file of lines for each event type and point."""
    key = F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), "event_type")
    pairs = t.table(spark, sf_dir, "events").select(
        t.station_id("user_id", 9).alias("STATION"), key.alias("key"), "value"
    )
    path = scratch_path(spark, "landed-pairs")
    pairs.where(F.col("value").isNotNull()).write.option("header", True).csv(path)
    return rounded(read_pairs(spark, path, "csv"))


def gridded_era5(spark, sf_dir):
    return rounded(normalize_gridded(t.gridded_pairs(spark, sf_dir), "era5"))


def gridded_era5_one_point(spark, sf_dir):
    return rounded(normalize_gridded(t.gridded_pairs(spark, sf_dir).drop("STATION"), "era5"))


def gridded_from_maps(spark, sf_dir):
    """The same extracts as maps from key to value."""
    maps = t.gridded_pairs(spark, sf_dir).select("STATION", F.create_map("key", "value").alias("pairs"))
    return rounded(normalize_gridded(reshape.explode_pairs(maps), "era5"))


def gridded_sst(spark, sf_dir):
    return rounded(normalize_gridded(t.sst_pairs(spark, sf_dir), "oisst"))


ON_DAILY: dict[str, OnDaily] = {
    "prepare_daily": prepare_daily_table,
    "remove_feb29": remove_feb29,
    "location_filter": location_filter,
    "station_names": station_names,
    "numeric_cast": numeric_cast,
    "date_bounds": date_bounds,
    "baseline_rows": baseline_rows,
    "daily_climatology_raw": daily_climatology_raw,
    "daily_climatology_feb29": daily_climatology_feb29,
    "daily_climatology_smooth": daily_climatology_smooth,
    "daily_climatology_even_window": daily_climatology_even_window,
    "daily_climatology_checked": daily_climatology_checked,
    "daily_climatology_pooled": daily_climatology_pooled,
    "observed_vs_climate": observed_vs_climate,
    "std_bands": std_bands,
    "envelopes": envelopes,
    "record_extremes": record_extremes,
    "record_days": record_days,
    "snow_accumulation": snow_accumulation,
    "daily_series": lambda daily: _series(daily, t.YEAR),
    "daily_series_winter": lambda daily: _series(daily, t.WINTER),
    "daily_series_past_end": lambda daily: _series(daily, t.PAST_END),
    "monthly_stats": monthly_stats,
    "monthly_stats_zero_sum": monthly_stats_zero_sum,
    "monthly_climate": monthly_climate,
    "monthly_climate_years": monthly_climate_years,
    "monthly_anomaly": monthly_anomaly,
    "precipitation_gate": precipitation_gate,
    "monthly_trailing": monthly_trailing,
    "monthly_temperature": _monthly("Temperature", False),
    "monthly_temperature_anomaly": _monthly("Temperature", True),
    "monthly_precipitation": _monthly("Precipitation", False),
    "monthly_precipitation_anomaly": _monthly("Precipitation", True),
    "missing_days": missing_days,
    "missing_ranges": missing_ranges,
    "contiguous_ranges": contiguous_ranges,
    "backfill_chunks": backfill_chunks,
    "completeness_months": completeness_months,
    "completeness_days": completeness_days,
    "completeness_stations": completeness_stations,
    "presence_after_upsert": presence_after_upsert,
    "backfill_from_index": backfill_from_index,
    "upsert_changes": upsert_changes,
    "months_rebuilt": months_rebuilt,
    "archive_published": archive_published,
    "index_published": index_published,
    "climatology_published": climatology_published,
    "climatology_from_state": _from_state(t.BASELINE),
    "climatology_from_state_cut": _from_state(t.CUT_BASELINE),
    "climatology_from_state_long": _from_state(t.LONG_BASELINE),
    "pad_calendar": pad_calendar,
    "upsert_keep_last": upsert_keep_last,
    "upsert_padded": upsert_padded,
    "service_records": service_records,
    "long_pivot_scaled": long_pivot_scaled,
    "long_pivot_padded": long_pivot_padded,
    "csv_roundtrip": csv_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "mixed_parquet": mixed_parquet,
    "mixed_csv": mixed_csv,
    "text_dates_in_range": text_dates_in_range,
    "upsert_newest": upsert_newest,
    "upsert_relabelled": upsert_relabelled,
    "landed_records": landed_records,
    "landed_rejects": landed_rejects,
    "responses_in_range": responses_in_range,
    "responses_rejected": responses_rejected,
    "requests_open": requests_open,
    "registry_of_stations": registry_of_stations,
    "registry_after_upsert": registry_after_upsert,
    "location_by_registry": location_by_registry,
    "climatology_in_order": climatology_in_order,
}

# The ones that a full calendar of days shows more of: also run with regions as stations.
DENSE = (
    "daily_climatology_feb29",
    "daily_climatology_smooth",
    "observed_vs_climate",
    "envelopes",
    "record_days",
    "snow_accumulation",
    "daily_series",
    "daily_series_winter",
    "daily_series_past_end",
    "monthly_climate",
    "monthly_temperature_anomaly",
    "monthly_precipitation_anomaly",
    "precipitation_gate",
    "monthly_trailing",
    "missing_ranges",
    "backfill_chunks",
    "completeness_months",
    "completeness_days",
    "completeness_stations",
    "backfill_from_index",
    "climatology_published",
    "climatology_from_state_cut",
    "upsert_padded",
)

ON_TABLES: dict[str, Query] = {
    "landing_json": landing_json,
    "numeric_inference": numeric_inference,
    "landed_pairs": landed_pairs,
    "gridded_era5": gridded_era5,
    "gridded_era5_one_point": gridded_era5_one_point,
    "gridded_from_maps": gridded_from_maps,
    "gridded_sst": gridded_sst,
    "nearest_cells": nearest_cells,
    "point_extract": point_extract,
}


def _on(level: str, query: OnDaily) -> Query:
    return lambda spark, sf_dir: rounded(query(t.station_daily(spark, sf_dir, level)))


def queries() -> dict[str, Query]:
    out = {name: _on("supplier", query) for name, query in ON_DAILY.items()}
    out |= {f"{name}_dense": _on("region", ON_DAILY[name]) for name in DENSE}
    return out | ON_TABLES
