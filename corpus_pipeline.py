"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before it kept, as a written table. Columns of the documents, of
whatever names, pass through every stage but the last, which returns its own. NULL texts are
empty texts: the quality rules reject them. Rows without doc_id are never near-duplicates, and
neither shorten others nor are shortened. An empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import packing, quality, simhash, store, suffixes, toxicity
from candlewick.llm.queries import documents, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    store.configure(spark)
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; three quarters of the labels teach the model."""
    store.configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.learn(docs, labels, toxicity.fold(F.col("doc_id"), 4) == 2)
    return toxicity.keep_clean(docs, machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id."""
    store.configure(spark)
    return simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes an earlier one holds."""
    store.configure(spark)
    return suffixes.dedup(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    store.configure(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]

# Fingerprints, tokens and suffix matches are beyond SQL; tests hold the stages against
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(store.configure(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
