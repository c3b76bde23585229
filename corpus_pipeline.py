"""Training corpus in five stages, each calling one operator on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import curriculum, decontaminate, line_dedup, near_dup, quality
from cuelake.llm.common import Scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are judged by what else is known of them, each of the rows that repeat an id by itself; without
    labels of both classes all have one score.  Other columns pass through; no rows give none.
    """
    return quality.keep_good(spark, docs, quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has lost all of its text goes with them.

    Null, empty and blank texts stay as they are, and so does every row without an id.  Rows that repeat an id with
    other texts have lines of their own; the first of equal lines stays.  Long texts are handled whole; n_chars follows
    the text where lines went.  Other columns pass through; no rows give none.
    """
    clean, _ = line_dedup.dedup_lines(spark, docs)
    emptied = (F.col("n_removed_") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    clean = clean.where(~F.coalesce(emptied, F.lit(False)))
    changed = F.when(F.col("n_removed_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id; further texts of one doc_id count after all others.

    Null, empty and blank texts are near nothing and stay, and so does every row without an id; of rows equal in id and
    text one stays.  Long texts count whole.  Other columns pass through; no rows give none.
    """
    rows = docs.where("doc_id is not null")
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = docs.withColumn("key_", F.col("doc_id").cast("long"))
    else:
        rows = rows.dropDuplicates(["doc_id", "text"]).withColumn("hash_", F.xxhash64("text"))
        first, last = rows.groupBy("doc_id").agg(F.min("hash_").alias("first_")), rows.agg(F.max("doc_id").cast("long").alias("last_"))
        key = F.when(F.col("hash_") == F.col("first_"), F.col("doc_id").cast("long")).otherwise(F.col("last_") + 1 + F.monotonically_increasing_id())
        rows = rows.join(first, "doc_id").crossJoin(F.broadcast(last)).select(*docs.columns, key.alias("key_"))
        rows = Scratch(spark, "keyed").store(rows.unionByName(docs.where("doc_id is null").withColumn("key_", F.lit(None).cast("long"))), "keyed")
    found = near_dup.near_duplicates(spark, rows.select(F.col("key_").alias("doc_id"), "text"))
    return rows.join(found.where("not kept").select(F.col("doc_id").alias("key_")), "key_", "left_anti").select(docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, row by row, whether their ids are null or repeat.

    Null and empty texts hold none, null and empty items are none.  Passages are found anywhere in a long text.  Other
    columns pass through; no rows give none.
    """
    rows = docs.withColumn("key_", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    found = decontaminate.contamination(spark, rows.select("key_", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key_")
    return rows.join(found.select(F.col("doc_id").alias("key_")).distinct(), "key_", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a row per copy taken, with its position.

    Null and empty texts have no words and no place in it.  A null source is a source of its own; rows that repeat an id
    are rows of their own.  Other columns pass through; no rows give none.
    """
    return curriculum.mixture(spark, docs)


STAGES = [("quality", quality_filter), ("line_dedup", dedup_lines), ("near_duplicates", dedup_documents), ("decontamination", decontaminate_documents), ("mixing", mix)]

#: Similarity search and a trained classifier have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
