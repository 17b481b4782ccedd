"""Landed point extracts of gridded data: key/value pairs ``YYYYMMDD_feature -> value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.reshape import explode_pairs

PAIRS = T.MapType(T.StringType(), T.DoubleType())


def read_pairs(spark: SparkSession, path: str | list[str], format: str = "parquet") -> DataFrame:
    """Key/value rows of extracts.

    ``json``: each file is one object and its fields are the keys. ``jsonl``: each line is one.
    A text that is no such object is an error. ``parquet`` and ``csv``: columns ``key`` and
    ``value``, and ``STATION`` if one table holds several points.
    """
    if format in ("json", "jsonl"):
        text = spark.read.text(path, wholetext=format == "json")
        objects = F.from_json("value", PAIRS, {"mode": "FAILFAST"})
        return explode_pairs(text.where(F.trim("value") != "").select(objects.alias("pairs")))
    if format == "parquet":
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif format == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"format must be parquet, csv, json or jsonl, got {format!r}")
    station = ["STATION"] if "STATION" in raw.columns else []
    return raw.select(*station, "key", F.col("value").cast("double").alias("value"))
