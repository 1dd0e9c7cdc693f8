"""The operators' queries over whole tables, as the repository's entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, neardup, packing, pii, secrets, sql, tiff, toxicity, urlrules
from .common import is_training, table

Query = Callable[[SparkSession, str], DataFrame]


def _held_out() -> F.Column:
    return (~F.coalesce(is_training(F.col("doc_id")), F.lit(True))).alias("held_out")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    marks = labels.select(F.col("doc_id").alias("_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    model = urlrules.mine(pages.join(marks, pages["page_id"] == marks["_id"]).select("url", "block"))
    return urlrules.judge(pages, model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held_out(), "score", "predicted")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", _held_out(), "lang_pred", "score")


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack_documents(table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.scan(docs, pii.train(docs)))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_tiff_media says of the payload; the stored form's bytes are beyond SQL."""
    return op6_tiff_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_personal_data says of the fixed formats, which no model decides."""
    found = pii.scan(table(spark, sf_dir, "documents"), pii.Model("", 1.0))
    return pii.digest(found).drop("spans")


def queries() -> dict[str, Query]:
    every = (
        op1_url_rules, op2_toxicity, op3_near_duplicates, op4_decontamination, op5_language,
        op6_tiff_media, op7_packing, op8_secrets, op9_licenses, op10_personal_data, media_payload, personal_data_base,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_rules": sql.url_rules(), "op3_near_duplicates": sql.NEAR_DUPLICATES, "op4_decontamination": sql.decontamination(), "op8_secrets": sql.secret_scan(),
        "media_payload": sql.MEDIA, "personal_data_base": sql.personal_data_base(),
    }
