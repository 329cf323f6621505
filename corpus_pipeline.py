"""A training corpus from documents: toxicity, quality, near duplicates, secrets, packing.

Each stage reads what the one before has kept, as a table in the shared folder. All but the last return the
columns of documents. A row without an id cannot stand for a group of near duplicates and is kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import packing, quality, secrets, simhash, toxicity
from nearfield.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model holds to be toxic go."""
    scored = toxicity.with_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("__severity.p_toxic") < toxicity.THRESHOLD).drop("__severity")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8) the smallest id stays, once."""
    return simhash.keep_first(docs).select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", keep_one_of_each), ("secrets", hide_secrets), ("packing", pack)]

#: Components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
