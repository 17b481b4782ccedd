"""Rows spread over tasks by key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key in as many partitions as the session shuffles into, all of which stay.

    Spark puts partitions of a shuffle of its own together until a task reads 64 MB. Rows such as
    these take some ten times that in memory, and a stage with several sorts or groupings holds them
    once for each. What follows needs no further shuffle if it is keyed by ``keys`` too.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
