"""The registered queries of this subpackage, and SQL with the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, license_scan, lm_score, mixing, near_dup, oracle, quality, spelling, substring_dedup, token_align, toxicity, url_filter
from .tables import table

#: Where the vocabularies of public tokenizers lie, on the driver alone.
TOKENIZERS = "/opt/tokenizers"
DOMAIN_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), _remainder(F.col("doc_id"), 10) == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_back(chat.format_conversations(turns))
    return read.select("conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, DOMAIN_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), _remainder(F.col("doc_id"), 4) != 2)
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.when(text == "", "").otherwise(F.sha2(text, 256))
    found = token_align.align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model", groups=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("found")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(table(spark, sf_dir, "documents")))


_ALL = (op1_substring_dedup, op2_lm_scoring, op3_quality_rules, op4_chat_formatting, op5_decontamination, op6_source_mixing, op7_url_filters, op8_html_extraction, op9_near_dup, op10_toxicity, op11_token_alignment, op12_license_scan, op13_spelling_variants)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = oracle.oracle_sql(DOMAIN_RULES)
