"""Helpers shared by the operators for training data."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The copy cuts the lineage, survives lost executors, keeps an expensive
    input from running once per consumer, and can be pruned by column.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/llm-{app}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of a key's text; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches of at most ``rows`` rows, to bound what is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterable, column: int, rows: int, size: int) -> Iterator:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes of text in ``column``, or one row."""
    for batch in slices(batches, rows):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            until = max(until, at + 1)
            yield batch.slice(at, until - at)
            at = until


def blocked(rows: DataFrame, keys: Sequence[str], ident: str, most: int) -> DataFrame:
    """Deal the members of every key out to tasks of at most about ``2 * most`` rows.

    A key with up to ``most`` rows is one task (``i = j = 0``). A larger key is
    cut into blocks by a hash of ``ident``, and every pair of blocks
    ``i <= j`` becomes a task of its own, so that all pairs of rows still meet
    exactly once: rows of block ``i`` have ``side`` 0 and rows of block ``j``
    ``side`` 1; where ``i = j`` there is only side 0.
    """
    keys = list(keys)
    large = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > most)
        .select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__blocks"))
    )
    own = F.pmod(F.xxhash64(F.col(ident), F.lit(17)), F.col("__blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("__blocks") - 1),
        lambda k: F.struct(
            F.least(own, k).alias("i"),
            F.greatest(own, k).alias("j"),
            F.when(own <= k, 0).otherwise(1).alias("side"),
        ),
    )
    return (
        rows.join(large, keys, "left")
        .withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
        .withColumn("__cell", F.explode(cells))
        .select(*rows.columns, "__cell.i", "__cell.j", "__cell.side")
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes ``0..n-1`` with links ``a - b``: the smallest node each one reaches."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
