"""Exact duplicates by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: The characters that do not count when texts are compared.
WHITE = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    """A text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_dedup(
    docs: DataFrame, prefix: int = 256, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when they agree after white space is deleted. Groups are
    refined in three steps. Rows alone in their length leave first, then rows
    alone in (length, hash of the first ``prefix`` characters); only what is
    left is joined back to its text and hashed whole (SHA-256). Of equal texts
    the one with the most code points, then the smallest ``doc_id``, stays.
    ``extra`` names columns computed from a document in that last reading.

    Each step is a pre-aggregated count and an equi-join, so that a hot length
    or a large group of copies is split by Spark and never sorted in one task.

    A null text counts as empty. A null ``doc_id`` yields to any other, and
    stays only in a group of nulls. Rows that repeat one ``doc_id`` with the same
    text are kept or dropped together. Other columns do not matter. An empty
    table gives an empty result.
    """
    plain = squeezed(F.col("text"))
    sizes = {
        "__chars": F.char_length(F.coalesce(F.col("text"), F.lit(""))),
        "__len": F.char_length(plain),
        "__head": F.xxhash64(F.substring(plain, 1, prefix)),
    }
    narrow = stored(docs.select(*[c.alias(n) for n, c in sizes.items()]), "lengths")
    lengths = narrow.groupBy("__len").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = (
        narrow.join(lengths.select("__len"), "__len", "left_semi")
        .groupBy("__len", "__head")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("__len", "__head", F.lit(True).alias("__open"))
    )
    full = F.when(F.col("__open"), F.sha2(squeezed(F.col("text")), 256)).otherwise(F.lit(""))
    rows = stored(
        docs.select("doc_id", "text", *[c.alias(n) for n, c in sizes.items()])
        .join(heads, ["__len", "__head"], "left")
        .select(
            "doc_id",
            "__chars",
            "__len",
            "__head",
            full.alias("__full"),
            *[c.alias(n) for n, c in (extra or {}).items()],
        ),
        "hashed",
    )
    key = ["__len", "__head", "__full"]
    rank = F.struct(
        (-F.col("__chars")).alias("c"), F.isnull("doc_id").alias("z"), F.col("doc_id").alias("i")
    )
    groups = rows.groupBy(*key).agg(
        F.min(rank).alias("__best"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(groups, key).select(
        "doc_id",
        F.col("__best.i").alias("keep_id"),
        "group_size",
        (
            F.col("doc_id").eqNullSafe(F.col("__best.i"))
            & (F.col("__chars") == -F.col("__best.c"))
        ).alias("kept"),
        *(extra or {}),
    )
