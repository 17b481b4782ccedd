"""What several operators need: stored intermediates, connected components, label folds."""

from __future__ import annotations

import gc
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources.scratch import scratch_path

MAX_ROUNDS = 60
_TITLE = re.compile("almanac_[0-9a-f]{32}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, see ``scratch_path``."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back. This cuts the lineage, and unlike a
    checkpoint it computes the plan once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, buckets: int, **options: str) -> DataFrame:
    """As ``stored``, in buckets of a key: grouping what is read by the key needs no shuffle. Spark
    keeps buckets for tables only, so this leaves one in the catalog, over the folder, until
    ``forget_tables`` is called."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    title = f"almanac_{path.rsplit('-', 1)[1]}"
    writer = df.write.options(**options).bucketBy(min(buckets, 100_000), key)
    writer.option("path", path).format("parquet").saveAsTable(title)
    return spark.table(title)


def forget_tables(spark: SparkSession) -> int:
    """Take the tables that ``stored_by`` left out of the catalog, once their queries have run; their
    files stay where they are. Gives their number."""
    names = [t.name for t in spark.catalog.listTables() if _TITLE.fullmatch(t.name)]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(names)


def release() -> None:
    """Give memory that Arrow holds for later back, at the end of a task that used much: Python
    processes outlive their tasks, and those of several stages share an executor."""
    pa.default_memory_pool().release_unused()


def clear_shuffles(spark: SparkSession) -> None:
    """Files of shuffles stay on the executors' disks until the driver's JVM finds that no plan uses
    them. Ask it to look now, after a step whose results are stored."""
    gc.collect()
    spark._jvm.System.gc()


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: which rows are held out of learning."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string")), F.lit(modulus))


def text_bytes(column: str | Column = "text") -> Column:
    """A text as UTF-8 bytes, a missing one as empty."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text.cast("binary"), F.lit(b""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(u, v)``: ``(id, component)``, the component being the
    smallest id reachable. Ids without a link have no row.

    Large star and small star alternate until nothing changes: O(log n) rounds, and a hub never
    meets in one task, because minima are aggregated partially and joined back. Each round is
    written to the shared folder, so that losing an executor costs one round.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(row)

    now = stored(ordered(edges), "links")
    last = mark(now)
    for _ in range(MAX_ROUNDS):
        if last[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m"))
        lows = lows.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(lows, "u")
        small = star.select("u", F.col("m").alias("v")).unionByName(
            star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = stored(small.distinct(), "links")
        mark_now = mark(now)
        if mark_now == last:
            break
        last = mark_now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return ids.unionByName(roots)
