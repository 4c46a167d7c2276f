"""The n-th largest value of every prefix of an ordered table, by a scan over mergeable summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Summaries that one task of the scan meets.
FAN = 64
_TOP = "block long, top array<double>"


def _top(values: np.ndarray, most: int) -> np.ndarray:
    """The largest ``most`` numbers, falling; nulls drop out."""
    values = values[~np.isnan(values)]
    if len(values) > most:
        values = np.partition(values, len(values) - most)[len(values) - most :]
    return np.sort(values)[::-1]


def _merged(lists, most: int) -> np.ndarray:
    found = [np.asarray(x, float) for x in lists if x is not None]
    return _top(np.concatenate(found), most) if found else np.empty(0)


def _summaries(rows: DataFrame, most: int) -> DataFrame:
    """The largest values of each block."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        top = _top(part["value"].to_numpy(float), most)
        return pd.DataFrame({"block": part["block"].iloc[:1], "top": [top]})

    return rows.select("block", "value").groupBy("block").applyInPandas(one, _TOP)


def _carried(summaries: DataFrame, blocks: int, most: int) -> DataFrame:
    """Per block, the largest values of all blocks before it.

    ``FAN`` blocks form a block of the level above; what comes before that one
    is found first, by the same rule, and then handed through its blocks in
    order. A task meets ``FAN`` summaries and one carried list.
    """
    spark = summaries.sparkSession
    above = F.floor(F.col("block") / FAN).cast("long")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": part["group"].iloc[:1], "top": [_merged(part["top"], most)]})

    def walk(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        now = _merged(before["top"], most)
        carried = []
        part = part.sort_values("block")
        for top in part["top"]:
            carried.append(now)
            now = _merged([now, top], most)
        return pd.DataFrame({"block": part["block"], "top": carried})

    if blocks <= FAN:
        before = spark.createDataFrame([], _TOP)
    else:
        larger = summaries.withColumn("group", above).groupBy("group").applyInPandas(merge, _TOP)
        before = _carried(larger, -(-blocks // FAN), most)
    return (
        summaries.withColumn("group", above)
        .groupBy("group")
        .cogroup(before.withColumn("group", F.col("block")).groupBy("group"))
        .applyInPandas(walk, _TOP)
    )


def prefix_thresholds(rows: DataFrame, chunks: int, most: int, per_block: int) -> DataFrame:
    """(``chunk``, ``threshold``): per prefix of whole chunks, its n-th largest value.

    ``rows`` holds ``chunk`` (long, 0 to ``chunks - 1``, in order), ``value``
    (double, nulls count as least) and ``n``, null but on one row of each chunk,
    where it says n for the prefix that ends with the chunk; no n is above
    ``most``. No prefix copies its rows: ``per_block`` chunks are a block, which
    has a summary of its ``most`` largest values; summaries are merged forward,
    and each block is scanned once from what it is handed. Rows, summaries and
    lists handed on are in proportion to the table.
    """
    blocked = rows.withColumn("block", F.floor(F.col("chunk") / per_block).cast("long"))
    blocks = -(-chunks // per_block)

    def scan(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        now = _merged(before["top"], most)
        found = []
        for chunk, own in part.groupby("chunk", sort=True):
            now = _merged([now, own["value"].to_numpy(float)], most)
            asked = own["n"].dropna()
            if len(asked):
                n = int(asked.iloc[0])
                found.append((chunk, now[n - 1] if n <= len(now) else None))
        return pd.DataFrame(found, columns=["chunk", "threshold"])

    carried = _carried(_summaries(blocked, most), blocks, most)
    return (
        blocked.select("block", "chunk", "value", "n")
        .groupBy("block")
        .cogroup(carried.groupBy("block"))
        .applyInPandas(scan, "chunk long, threshold double")
    )
