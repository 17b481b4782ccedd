"""A corpus made ready for training, in stages over the documents.

Each stage works on all documents its predecessor kept, and is written to the shared folder before
the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import decontaminate, pii, simhash, toxicity
from almanac.llm.common import stored, table, text_bytes
from almanac.llm.queries import TOXIC_FROM, encoded, toxicity_model

#: SQL can express neither the learned stages nor the edit distance to every window.
ORACLE_SQL = None


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic score go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    # The score is a function of the text alone.
    digest = F.sha2(text_bytes("text"), 256)
    scored = toxicity.with_score(docs.select("text", digest.alias("digest")), model)
    bad = stored(scored.where(F.col("score") >= TOXIC_FROM).select("digest").distinct(), "toxic")
    return docs.join(bad, digest == bad["digest"], "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    return simhash.keep_first(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds; the length is that of the new text."""
    text = pii.redact(F.col("text"), pii.fit(docs))
    clean = docs.withColumn("text", text)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with digests of them and of what they decode to."""
    return encoded(docs, with_ids=True)


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_items),
    ("pii", personal_data),
    ("byte-level bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
