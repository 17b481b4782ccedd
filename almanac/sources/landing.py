"""Landed responses of the daily-summaries service: JSON arrays of records.

A file holds one body, or many as a JSON text sequence (RFC 7464): each begins with the character RS,
which no JSON text holds. Files have costs of their own, so very many bodies belong in sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.schema import SERVICE_RECORD


RS = "\x1e"


def records_in(body: Column, record: T.StructType = SERVICE_RECORD) -> Column:
    """The records of a body; null unless it is a JSON array of nothing but records. An object, such
    as an error of the service, is none, and neither is an array whose elements have neither a
    station nor a day."""
    parsed = F.from_json(body, T.ArrayType(record))
    keys = [c for c in ("STATION", "DATE") if c in record.fieldNames()] or record.fieldNames()
    fine = F.forall(parsed, lambda r: F.coalesce(*(r[k].cast("string") for k in keys)).isNotNull())
    return F.when(F.ltrim(body).startswith("[") & fine, parsed)


def _bodies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The bodies of files that hold one each, and of sequences. What precedes the first of a sequence
    is empty, and no body: a file of one body has at least a character."""
    return spark.read.text(path, lineSep=RS).where("value != ''")


def write_bodies(bodies: DataFrame, path: str, body: str = "body") -> None:
    """Land bodies as sequences, a file for each partition."""
    bodies.select(F.concat(F.lit(RS), body).alias("value")).write.text(path)


def read_service_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records of all landed files. A body that ``rejected_bodies`` lists adds no rows, and
    neither does an empty array."""
    return _bodies(spark, path).select(F.inline(records_in(F.col("value"))))


def rejected_bodies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The bodies that are blank, malformed or no array of records, with the file each is from.
    Files of zero bytes have no body, so those are not listed."""
    return (
        _bodies(spark, path)
        .where(records_in(F.col("value")).isNull())
        .select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    )


def decode_records(
    df: DataFrame, body: str = "body", record: T.StructType = SERVICE_RECORD
) -> DataFrame:
    """Rows of the record arrays held as JSON text in one column; other columns are repeated.
    Text that is no array of records adds no rows."""
    others = [c for c in df.columns if c != body]
    return df.select(*others, F.inline(records_in(F.col(body), record)))


def json_value(body: str, name: str, data_type: str) -> Column:
    """One field of a JSON object held as text; null if the text or the field is no good."""
    return F.from_json(body, f"{name} {data_type}")[name]
