"""Connected components of a link table that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _mark(links: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row["n"], row["x"]


def _hang_on_least(links: DataFrame) -> DataFrame:
    """Every neighbour above a node moves over to the least node around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    )


def _gather_below(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        links.join(least, "u")
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``): the least node that each linked node reaches.

    ``links`` has two bigint columns ``a`` and ``b``; order, repeats and
    self-links do not matter, nulls are left out. Nodes without links to
    others are not in the result. The links shrink to one star per component
    by alternating two moves (hang larger neighbours on the least one, gather
    smaller ones under it); every round is joins and pre-aggregated group-bys
    on tables in the shared folder, and only two numbers reach the driver.
    """
    now = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(now)
    while mark[0]:
        now = stored(_gather_below(_hang_on_least(now)), "links")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
