"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontaminate, filter_audit, importance, licenses, line_dedup, media, near_dup, quality, quotations, suffix_dedup, toxicity, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    files = warc.write_warc(spark, _table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    return warc.read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = quality.score(spark, docs, quality.fit(spark, docs, labels))
    return out.withColumn("kept", F.col("score") >= quality.MIN_SCORE)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    folder = scratch.path("archives")
    files = media.write_media(_table(spark, sf_dir, "documents"), folder, scratch)
    return media.media_features(media.read_media(spark, folder, files, scratch=scratch))


def op5_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = quotations.conversations(quotations.link_quotations(spark, _table(spark, sf_dir, "conversations")))
    rows = threads.select("conv_id", "thread", F.posexplode("messages").alias("place", "m")).select("conv_id", "thread", "place", "m.*")
    return rows.select("conv_id", "turn", "role", F.md5("content").alias("body_md5"), F.length("content").alias("body_chars"), "reply_to", "thread", "depth", F.array_join("path", ">").alias("path"), "place")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = line_dedup.dedup_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=line_dedup.FINE, short=True)
    return docs.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.length("text").alias("clean_chars"), F.md5("text").alias("clean_md5"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(spark, docs, toxicity.fit(spark, docs, _table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = curriculum.placed(spark, _table(spark, sf_dir, "documents"))
    return placed.sort(F.try_element_at("positions", F.lit(1)), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(spark, _table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_quality, op3_near_duplicates, op4_media, op5_quotations, op6_licenses, op7_line_dedup, op8_toxicity, op9_decontamination, op10_mixing, op11_suffix_dedup, op12_importance, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op5_quotations": quotations.ORACLE, "op6_licenses": licenses.oracle(), "op10_mixing": curriculum.ORACLE, "op11_suffix_dedup": suffix_dedup.ORACLE, "op12_importance": importance.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
