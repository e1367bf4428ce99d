"""The training-data pipeline: stages over documents, each written as Parquet and read again as the next one's documents.

``STAGES`` are (name, function of (spark, docs, sf_dir)).  All but the last
return the columns of documents; the last adds ``copy``, the number of the copy
that the mix takes of a document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortveil.llm import decontaminate, mixing, near_dup, quality, substring_dedup
from cohortveil.llm.tables import fresh, shared_folder, table

#: SQL can't express the quality rules' hashed multinomials; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the likelihood ratio."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return judged.where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike in 0.8 of their shingles of five words: the one with the least id."""
    row, own_key, own_id = fresh(docs.columns, "_row", "_first", "_first_id")
    first = near_dup.group(docs, width=5).where("is_first").select(F.col("key").alias(own_key), F.col("doc_id").alias(own_id)).distinct()
    rows = docs.withColumn(row, F.struct(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), F.col("doc_id").alias("id")))
    kept = rows.join(first, (F.col(f"{row}.key") == F.col(own_key)) & F.col(f"{row}.id").eqNullSafe(F.col(own_id)), "left_semi")
    return kept.dropDuplicates([row]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those with nothing left go."""
    found = substring_dedup.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns).where("n_hit = 0").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs.withColumn("size", mixing.n_words(F.col("text"))))
    return mixed.where("copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents.  Stages are written to the folder that :func:`shared_folder` names."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for nth, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{nth}-{name}")
        docs = spark.read.parquet(f"{folder}/{nth}-{name}")
    return docs
