"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, folder of tables) and works on all rows its predecessor
kept. `run` writes what a stage returns to the shared folder and rereads it, so a stage is
computed once and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, neardup, packing, suffixes, toxicity
from quarry.llm.common import materialize, released, scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled ones."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, from similarity 0.8 on, stays: that of the smallest id."""
    return neardup.keep_one(docs, neardup.STAGE_LINK)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id has are cut out."""
    return suffixes.dedup(docs, with_rows=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each time a document is taken."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; rows of the last stage. What a stage leaves is deleted once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as keep:
            docs = keep(materialize(stage(spark, before, sf_dir), name))
        released(before)
    return docs
