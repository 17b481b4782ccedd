"""Station tables derived from the generated tables, as DataFrames.

A supplier is a station and a ship date a day (``supplier``): sparse records, and as many
stations as there are suppliers. ``region`` makes each region a station: few stations with a row
for nearly every day, so that full climatologies are covered too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.spread import spread
from almanac.sources import landing

# Parameters of the queries.
BASELINE = ("1996-01-01", "1999-12-31")
YEAR = ("2000-01-01", "2000-12-31")
WINTER = ("1999-07-01", "2000-06-30")
PAST_END = ("2001-01-01", "2001-12-31")
WINDOW = 7
TRAILING = 12
STATUS_END = "2001-10-25"
CUT_BASELINE = ("1994-03-15", "2000-10-02")
LONG_BASELINE = ("1993-01-01", "2000-12-31")
REACH_KM = 300.0
REPORT = ("1996-02-03", "1999-12-11")
LEAST_SHARE = 0.25
DATATYPES = ("TMIN", "TMAX", "PRCP", "SNOW")

# Event types stand for the features of a reanalysis extract.
ERA5_FEATURES = {
    "click": "mean_2m_air_temperature",
    "error": "minimum_2m_air_temperature",
    "purchase": "maximum_2m_air_temperature",
    "signup": "dewpoint_2m_temperature",
    "view": "total_precipitation",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_daily(spark: SparkSession, sf_dir: str, level: str = "supplier") -> DataFrame:
    """The daily table. Lines are reduced to supplier days before they meet the dimensions, so
    that a supplier with very many lines has one row per day by then. The days meet them spread by
    supplier: else the task that reduces the lines also holds what a query groups of them."""
    date = F.col("l_shipdate").cast("date")
    winter = F.month(date).isin(11, 12, 1, 2, 3)
    number = F.col("l_linenumber")
    per_supplier = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", date.alias("DATE"))
        .agg(
            F.sum(number).alias("prcp"),
            F.max("l_quantity").alias("tmax"),
            F.min(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("tmin"),
            F.sum(F.when((F.col("l_returnflag") == "R") & winter, number)).alias("snow"),
        )
    )
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    days = spread(per_supplier, "l_suppkey")
    rows = days.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    if level == "region":
        rows = rows.groupBy("n_regionkey", "r_name", "DATE").agg(
            F.sum("prcp").alias("prcp"),
            F.max("tmax").alias("tmax"),
            F.min("tmin").alias("tmin"),
            F.sum("snow").alias("snow"),
        )
        station, name = station_id("n_regionkey", 3), F.col("r_name")
    else:
        station = station_id("l_suppkey", 12)
        name = F.concat_ws(", ", "s_name", "n_name", "r_name")
    return rows.select(
        station.alias("STATION"),
        name.alias("NAME"),
        "DATE",
        F.col("prcp").cast("double").alias("PRCP"),
        F.lit(None).cast("double").alias("SNWD"),
        F.lit(None).cast("double").alias("TAVG"),
        (F.col("tmax") - 25).alias("TMAX"),
        (F.col("tmin") - 25).alias("TMIN"),
        F.col("snow").cast("double").alias("SNOW"),
    )


def station_id(key: str, digits: int):
    """At least so many digits; a longer key stays whole."""
    text = F.col(key).cast("string")
    return F.concat(F.lit("ST"), F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0")))


def archive(daily: DataFrame) -> DataFrame:
    """The daily table with days missing: the 10th to 14th and the 20th of each month."""
    day = F.dayofmonth("DATE")
    return daily.where(~(day.between(10, 14) | (day == 20)))


def fetched(daily: DataFrame) -> DataFrame:
    """Rows to merge: those the archive lacks in the series year, and changed copies of the
    first three days of its months. They come without a label."""
    day = F.dayofmonth("DATE")
    changed = day.between(1, 3)
    of_year = daily.where(F.col("DATE").between(*YEAR))
    wanted = of_year.where(changed | day.between(10, 14) | (day == 20))
    return wanted.withColumns(
        {
            "NAME": F.lit(None).cast("string"),
            "PRCP": F.when(changed, F.col("PRCP") + 1).otherwise(F.col("PRCP")),
        }
    )


def emptied(fetched: DataFrame) -> DataFrame:
    """The fetched rows, where those of the second of a month turn out to hold no data."""
    measures = ("PRCP", "SNWD", "TAVG", "TMAX", "TMIN", "SNOW")
    keep = F.dayofmonth("DATE") != 2
    return fetched.withColumns({c: F.when(keep, F.col(c)) for c in measures})


def service_bodies(daily: DataFrame) -> DataFrame:
    """Service responses, a JSON array per station and year, and a broken one per station."""
    record = F.struct(
        "STATION",
        F.date_format("DATE", "yyyy-MM-dd").alias("DATE"),
        *(F.col(c).cast("string").alias(c) for c in DATATYPES),
    )
    good = (
        daily.groupBy("STATION", F.year("DATE").alias("y"))
        .agg(F.to_json(F.collect_list(record)).alias("body"))
        .select("body")
    )
    broken = daily.select("NAME").distinct().select(
        F.concat(F.lit("<html>"), "NAME", F.lit("</html>")).alias("body")
    )
    return good.unionByName(broken)


def rejected(daily: DataFrame) -> DataFrame:
    """Bodies that are no records, of each kind one per station: a page, an error object, arrays of
    something else, and one that was cut off."""
    r = F.col("r")
    return (
        daily.select(F.col("STATION").alias("r"))
        .distinct()
        .select(
            F.explode(
                F.array(
                    F.concat(F.lit("<html>"), r, F.lit("</html>")),
                    F.concat(F.lit('{"errorCode":400,"station":"'), r, F.lit('"}')),
                    F.concat(F.lit('["'), r, F.lit('"]')),
                    F.concat(F.lit('[{"other":"'), r, F.lit('"}]')),
                    F.concat(F.lit('[{"STATION":"'), r),
                )
            ).alias("body")
        )
    )


def write_bodies(bodies: DataFrame, path: str) -> None:
    """Sequences of bodies; tests of the sources have a file for each body."""
    landing.write_bodies(bodies, path)


def responses(daily: DataFrame) -> DataFrame:
    """The answers to a request for each station and year: records, but a body of zero bytes for
    1997 and a page for 1998."""
    record = F.struct(
        "STATION",
        F.date_format("DATE", "yyyy-MM-dd").alias("DATE"),
        *(F.col(c).cast("string").alias(c) for c in DATATYPES),
    )
    year = F.year("DATE").alias("y")
    answers = daily.groupBy("STATION", year).agg(F.to_json(F.collect_list(record)).alias("body"))
    body = F.when(F.col("y") == 1997, "").when(F.col("y") == 1998, "<html></html>").otherwise(F.col("body"))
    return answers.select(
        "STATION", F.make_date("y", F.lit(1), F.lit(1)).alias("chunk_start"),
        F.make_date("y", F.lit(12), F.lit(31)).alias("chunk_end"), body.alias("body"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations with a place, also near the poles and on both sides of the date line."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        station_id("s_suppkey", 12).alias("STATION"),
        ((key * 37) % 1781 / 10 - 89.0).alias("lat"),
        ((key * 1013) % 3600 / 10 - 180.0).alias("lon"),
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the events as cells of a grid, with longitudes from 0 to 360."""
    key = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cell"),
        ((key * 53) % 179 - 89).cast("double").alias("lat"),
        ((key * 97) % 360 + 0.5).alias("lon"),
    ).distinct()


def long_records(daily: DataFrame) -> DataFrame:
    """One row per station, day and data type, in tenths; missing values have no row."""
    entries = F.array(
        *(
            F.struct(F.lit(c).alias("datatype"), (F.col(c) * 10).alias("value"))
            for c in DATATYPES
        )
    )
    stamp = F.concat(F.col("DATE").cast("string"), F.lit("T00:00:00"))
    return daily.select("STATION", stamp.alias("date"), F.inline(entries)).where(
        F.col("value").isNotNull()
    )


def gridded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as key/value pairs of a reanalysis extract; each user is a grid point."""
    names = F.create_map(*(F.lit(x) for pair in ERA5_FEATURES.items() for x in pair))
    return table(spark, sf_dir, "events").select(
        station_id("user_id", 9).alias("STATION"),
        F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), names[F.col("event_type")]).alias("key"),
        "value",
    )


def sst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as key/value pairs of a sea-surface extract: views are ``sst``, others are not."""
    feature = F.when(F.col("event_type") == "view", F.lit("sst")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        station_id("user_id", 9).alias("STATION"),
        F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), feature).alias("key"),
        "value",
    )


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text: some columns are numbers, some are not, one is nearly."""
    quantity = F.col("l_quantity").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order"),
        quantity.alias("quantity"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(quantity).alias("mixed"),
        F.when(F.col("l_linestatus") == "F", quantity).alias("partly_missing"),
        F.col("l_returnflag").alias("flag"),
        *(
            F.when(F.col("l_linenumber") == 7, F.lit(odd)).otherwise(quantity).alias(name)
            for name, odd in (("with_empty", ""), ("infinite", "-Infinity"), ("not_a_number", "nan"))
        ),
    )
