"""A training-data pipeline over the documents table: five stages, each on all that the one before kept.

Every stage but the last returns the columns of documents: the quality classifier drops rejected rows,
SimHash keeps one row of each group, the suffix stage cuts repeated strings out of texts, decontamination
drops contaminated rows. The last stage packs what is left into sequences.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.llm import decontaminate, packing, quality, repeats, simhash
from snaplake.llm.store import importable, stored
from snaplake.llm.workload import table, tokenizer_path


def _stage(build):
    """A stage on a session whose Python workers are set up."""

    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return build(importable(spark), docs, sf_dir)

    return run_stage


@_stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the classifier scores 0.5 or more; learned from the labelled rows outside the held-out third."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_stage
def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least id."""
    return simhash.keep_one(docs)


@_stage
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; strings of 200 bytes that stand twice are cut out of every text, and n_chars follows."""
    cut = repeats.remove_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


@_stage
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in benchmark windows."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", unlike),
    ("suffix-array dedup", unrepeated),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

#: The classifier, the fingerprints and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(importable(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
