"""A corpus pipeline: from documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept:

1. toxicity: documents scored at 0.7 or more by their nearest labelled examples go;
2. exact dedup: of equal texts the one with the smallest id stays;
3. near-dedup: one document of each group of near copies stays (five-word shingles, similarity 0.8);
4. mixing: sources are repeated or drawn to their targets, so a document can be there several times;
5. packing: the mixed documents become sequences of at most 4096 tokens.

Null ids and texts, empty tables, repeated rows and columns of any name are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from supplylens.llm import exact_dedup as exact
from supplylens.llm import mixing as mixes
from supplylens.llm import near_dedup as near
from supplylens.llm import packing as packs
from supplylens.llm import toxicity as toxic
from supplylens.llm.common import shared_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic. A null or empty text is scored like any other and stays unless the examples say otherwise; repeated rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.drop_toxic(docs, toxic.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each different text. Null counts as empty, so one such row stays; the smallest id stays, a null id only where its group has no other."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Texts without words, and rows without id, are copies of nothing and stay."""
    return near.drop_near_duplicates(docs, k=5, threshold=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, the last of each draw cut to its first words. Documents without words have nothing to take and go."""
    return mixes.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence. Rows without id are packed like any other."""
    return packs.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Nearest neighbours, similarity components and token packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the shared folder, so that no later stage works it out again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
