"""A training corpus out of `documents`: toxic ones go, one of each near-duplicate class stays, personal data get surrogates, sources are mixed to weights, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.llm import mixing, neardup, packing, pii, scratch, toxicity
from galleyworks.llm.queries import SURROGATE_KEY
from galleyworks.session import prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Null and empty texts score as no words do, and stay; repeated rows go or stay together; without labels of both classes all stay; extra columns pass, whatever their names."""
    model = toxicity.fit(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scorer(spark, model)(F.col("text"))["score"] < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the smallest doc_id (null last), of ties the least text hash, of rows alike one. Null, empty and wordless texts are one class; extra columns pass, whatever their names."""
    prepare(spark)
    return neardup.without_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts and n_chars counted anew. Null texts stay null, empty ones empty; equal texts change alike; extra columns pass, whatever their names."""
    prepare(spark)
    return pii.pseudonymise(docs, SURROGATE_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document none, one or two times, as its source's target asks. Null sources are one source; null and empty texts have no words and go by their hash; rows alike are taken alike; extra columns pass, whatever their names."""
    prepare(spark)
    return mixing.mixed(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its text, bin and place there: the corpus can be read from it. Null and empty texts are one empty piece; rows alike are packed each for itself; other columns are not read. Every stage gives an empty table for an empty one."""
    prepare(spark)
    return packing.packed_texts(docs)


STAGES = [("toxicity", drop_toxic), ("minhash near-dedup", drop_near_duplicates), ("pii surrogates", replace_personal_data), ("source mixing", mix_sources), ("best-fit packing", pack_bins)]
#: Training, sampling and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written, and what its stage wrote on the way, and the result before it, is removed then."""
    docs, before = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        mark = len(scratch.made)
        docs = scratch.materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        *on_the_way, result = scratch.made[mark:]
        scratch.remove(spark, before + on_the_way)
        before = [result]
    return docs
