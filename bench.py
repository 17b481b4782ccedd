"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. The daily table is
derived and stored as an archive first, which is timed too; each query then reads it (or the given
tables) and computes all result rows. Nothing is kept in memory between queries. Every query runs twice: the
first run pays for compiling, and is reported as ``first_run``; the second is the result.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from almanac.session import local_session  # noqa: E402
from almanac import read_daily, write_daily  # noqa: E402
from almanac.sources.scratch import scratch_path  # noqa: E402
from workload import tables  # noqa: E402
from workload.queries import ON_DAILY, ON_TABLES, rounded  # noqa: E402

HEADLINE = (
    "prepare_daily",
    "daily_climatology_raw",
    "daily_climatology_smooth",
    "daily_series",
    "daily_series_winter",
    "record_days",
    "snow_accumulation",
    "monthly_climate",
    "monthly_temperature_anomaly",
    "monthly_precipitation_anomaly",
    "missing_ranges",
    "backfill_chunks",
    "upsert_padded",
    "service_records",
    "long_pivot_scaled",
    "gridded_era5",
    "gridded_sst",
    "numeric_inference",
)


def compute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "8g"))
    # The first job of a session pays for starting up, whichever query it belongs to.
    compute(tables.station_daily(spark, sf_dir, "region"))

    def timed(run) -> float:
        started = time.perf_counter()
        run()
        return round(time.perf_counter() - started, 3)

    path = scratch_path(spark, "daily")

    def run(name: str) -> None:
        if name in ON_TABLES:
            compute(ON_TABLES[name](spark, sf_dir))
        else:
            compute(rounded(ON_DAILY[name](read_daily(spark, path))))

    first, seconds = {}, {}
    for times in (first, seconds):
        times["store_daily"] = timed(
            lambda: write_daily(tables.station_daily(spark, sf_dir), path, clustered=True)
        )
        for name in HEADLINE:
            times[name] = timed(lambda name=name: run(name))
    spark.stop()
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "first_run": round(sum(first.values()), 3),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
