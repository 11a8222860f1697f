"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.llm import ann, fingerprint, hard_negatives, html_extract, mixing, neardup, packing, pii, prefix_trie, secret_scan, simhash, token_count, toxicity
from galleyworks.llm.oracles import ORACLES
from galleyworks.session import prepare

#: The key of op7's surrogates over the test tables; a corpus of one's own needs a secret one.
SURROGATE_KEY = "surrogate-key-1"
#: The unigram vocabulary of op9; a path on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    scored = toxicity.with_score(documents.select("doc_id", "text"), model)
    score = F.col("toxicity.score")
    return scored.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.average").alias("average_score"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return ann.neighbours(embeddings, embeddings.filter(F.col("vec_id") % 20 == 0))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.with_token_count(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY).select("doc_id", "n_tokens")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.scaled(embeddings.withColumn("label", label)), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_best_fit_packing, op3_toxicity, op4_minhash_near_dedup, op5_secret_scan, op6_source_mixing, op7_pii_surrogates, op8_nearest_neighbours, op9_token_count, op10_fingerprints,
        op11_simhash_near_dedup, op12_hard_negatives, op13_prefix_trie,
    )
}

__all__ = ["ORACLES", "QUERIES"]
