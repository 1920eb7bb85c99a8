"""Corpus cleaning: documents go through the stages in order, each written as Parquet and read again by the next.

1. ``language_id`` drops the documents whose language is not recognised, texts without a letter among them.
2. ``line_dedup`` takes the boilerplate lines of a source out of its documents.
3. ``near_duplicates`` keeps one document of each group of near duplicates, the one with the smallest id.
4. ``packing`` cuts the texts into pieces and packs these into training sequences.

All stages but the last return the columns they were given.  An empty table goes through as an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import language_id, line_dedup, packing, simhash
from ledgerlens.llm.common import fresh, held_back, read_table, remove, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = "byte_bpe_50k.json"


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the labelled documents; null texts and texts without a letter go."""
    learn = ~held_back(F.col("doc_id"), parts=4, part=2)
    names = fresh(docs, "lang_pred", "score", "rejected")
    judged = language_id.identify(docs, learn, keep=docs.columns, names=names)
    return judged.filter(~F.col(names[2])).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; no document goes."""
    return line_dedup.drop_boilerplate(docs, host="source", count=None)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id, once if its row is repeated.

    A row with a null doc_id cannot be named as the one of its group and stays.
    """
    groups = simhash.near_duplicates(docs, shingle=3, distance=3, seed=42)
    (surplus,) = fresh(docs, "surplus_id")
    others = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(surplus)).distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(others, F.col("doc_id") == F.col(surplus), "left_anti")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), length=1024)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", recognised_language),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_near_duplicates),
    ("packing", packed),
]

#: Language models and bin packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
