"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import (
    bpe,
    cover_tree,
    decontaminate,
    filter_audit,
    language,
    licenses,
    pii,
    quality,
    simhash,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from almanac.llm.common import fold, shared_path, table

TOXIC_FROM = 0.3
ARCHIVE_DATE = "2024-01-01T00:00:00Z"
DOMAIN_RULES = (
    url_filter.domain_rule("net", "/", "block"),
    url_filter.domain_rule("example.net", "/en/", "allow"),
    url_filter.domain_rule("example.com", "/de/", "block"),
    url_filter.domain_rule("org", "/fr/", "allow"),
)
#: For URLs that no domain rule fits.
BLOCKED_GLOBS = ("*spam**", "*cheap-pills**", "*casino**", "*free-bets**", "**/wp-login**", "**.exe", "**.zip")


def encoded(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Digests of the ids of each text, and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    finish = bpe.digests(docs.sparkSession.sparkContext.broadcast(ranks), with_ids)
    schema = bpe.DIGESTS + (", ids binary" if with_ids else "")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, then=finish, schema=schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning; one without an id is not."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learnt from the labelled documents that are not held out. Labels grow with the documents, so
    both are shuffled, at any size."""
    learn = docs.where(fold("doc_id", 4) != 2).select("doc_id", "text")
    return toxicity.fit(learn.join(labels.select("doc_id", "toxic").hint("merge"), "doc_id"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages"), ARCHIVE_DATE), path)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]*):", 1)
    # Only responses have a payload; of all records the headers are enough.
    bodies = (
        warc.read_warc(spark, path, once=True).where("warc_type = 'response'")
        .select(
            F.col("record_id").alias("body"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            warc.base32_sha1(F.col("payload")).alias("payload_digest"),
        )
        .distinct()
    )
    heads = warc.read_warc(spark, path, payload=False).select(
        page("record_id").try_cast("long").alias("page_id"),
        F.col("warc_type").alias("record_type"),
        F.coalesce("refers_to", "record_id").alias("body"),
        page("refers_to").try_cast("long").alias("refers_to"),
    )
    return heads.join(bodies, "body").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*DOMAIN_RULES, *url_filter.glob_rules(BLOCKED_GLOBS, "block")]
    url = F.col("url")
    found = table(spark, sf_dir, "pages").select(
        "page_id", url, url_filter.judge(url, rules).alias("found")
    )
    own = url_filter.parts(url)
    return found.select(
        "page_id",
        own["host"].alias("host"),
        own["path"].alias("path"),
        F.when(F.col("found.rule").isin([r.name for r in DOMAIN_RULES]), F.col("found.rule"))
        .alias("rule"),
        F.col("found.verdict").alias("verdict"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(4, 2), "score"
    ).withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return docs.select(
        "doc_id",
        held_out(3, 1),
        quality.score(docs, quality.fit(docs, labels)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def _span_text(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.spans(F.col("text"), pii.fit(docs)).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(_span_text(base), 256).alias("base_sha256"),
        _span_text(F.col("spans")).alias("spans"),
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(5, 0)).select("doc_id", "text", "lang"))
    return docs.select(
        "doc_id", held_out(5, 0), language.predict(F.col("text"), model).alias("p")
    ).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
        F.col("p.accepted").alias("accepted"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_licenses": op2_licenses,
        "op3_quality": op3_quality,
        "op4_decontamination": op4_decontamination,
        "op5_pii": op5_pii,
        "op6_embeddings": op6_embeddings,
        "op7_simhash": op7_simhash,
        "op8_warc": op8_warc,
        "op9_url_filter": op9_url_filter,
        "op10_toxicity": op10_toxicity,
        "op11_language": op11_language,
        "op12_filter_audit": op12_filter_audit,
        "op13_whitening": op13_whitening,
    }
