"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next one's ``docs``. All but the last return the
columns of ``documents``, unchanged, for the rows that stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, language, near_text, packing
from tidemark.llm.common import fold, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those whose text is null or has no letter go.

    Prototypes are learned from the documents of this stage that are not held out (fold 0 of 5).
    """
    profiles = language.fit_languages(docs.where(fold(F.col("doc_id"), 5) != 0))
    return language.keep_known(docs, profiles)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Rows are told apart by ``doc_id``; rows without one stay.
    """
    dropped = exact.exact_dedup(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints.

    Rows are told apart by ``doc_id``; rows without one stay.
    """
    dropped = (
        near_text.simhash_near_dedup(docs)
        .where(F.col("doc_id") != F.col("component_id"))
        .select("doc_id")
        .distinct()
    )
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("exact", no_exact_copies),
    ("near", no_near_copies),
    ("pack", packed),
]

#: SQL has neither the fingerprints nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
