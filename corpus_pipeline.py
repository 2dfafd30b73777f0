"""A corpus pipeline of five operators, each over what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
stage's docs.  All but the last return the columns of documents, whatever columns there are.

Rows with null ids are rows like others in every stage; null and empty texts aren't toxic,
no copies of others, not contaminated and without secrets, so they stay and have no tokens;
of rows that are equal in all columns one stays.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import bpe, decontam, minhash, secrets, toxicity
from tessel.llm.queries import ranks_path
from tessel.llm.store import Store

#: Classifiers and tokens aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; each row is judged by its own text."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8."""
    return minhash.deduplicate(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind in brackets."""
    return secrets.mask(docs, ranks_path())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the bytes decoded from them."""
    return bpe.encode(docs, ranks_path(), outputs=("ids", "decoded_sha256"))


STAGES = [("toxicity", clean), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("secrets", mask_secrets), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's result is written before the next one."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = store.table(name, stage(spark, docs, sf_dir))
        if k:
            store.drop(STAGES[k - 1][0])
    return docs
