"""The contract queries of the operators in this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, near_dedup, pii, source_mix, subword_lm, toxicity, url_filter, winnowing
from ._common import held, table

#: Pseudonyms in this query use a published key; production passes its own to pii.pseudonymise().
PII_KEY = b"rooftide-published-demonstration"


def op1_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_lm.score_documents(table(spark, sf_dir, "documents"), held("doc_id", 7, 2))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~held("doc_id", 3, 1))
    named = language_id.identify(docs, model)
    return named.select("doc_id", held("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", F.size("pii_spans").cast("long").alias("n_values"), pii.counts_by_kind().alias("kinds"), "text")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, training = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held("doc_id", 5, 0)
    model = toxicity.calibrate(docs, labels, training, toxicity.fit(docs, labels, training))
    scored = toxicity.score(docs, model, ("doc_id",), lang_col="lang")
    return scored.select("doc_id", held("doc_id", 5, 0).alias("held_out"), "score", "predicted", "flagged")


QUERIES = {
    f.__name__: f
    for f in (op1_subword_lm, op2_decontaminate, op3_language_id, op4_pii, op5_source_mix, op6_near_dedup, op7_line_dedup, op8_url_filter, op9_winnowing, op10_toxicity)
}
