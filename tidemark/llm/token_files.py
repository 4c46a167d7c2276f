"""Token ids as Parquet files in id order, for selective reads."""

from __future__ import annotations

import functools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import encoder
from tidemark.llm.common import text_slices
from tidemark.session import shared_dir

_PIECE = 2 << 20
FILE_SCHEMA = "part int, pos bigint, doc_id bigint, n_tokens bigint, ids array<int>"


def id_list(encoded: list[bytes]) -> pa.Array:
    """Arrow list<int32> of little-endian id bytes."""
    sizes = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4"))
    )


def _encode(batches, path, blanks, end_id):
    from pyspark import TaskContext

    part, pos = TaskContext.get().partitionId(), 0
    for batch in text_slices(batches, 1, 2048, _PIECE):
        ids, texts = batch.columns
        codes, sizes = encoder(path, blanks).encode_flat(texts)
        ends = np.cumsum(sizes)
        codes = np.insert(codes.astype(np.int32), ends, end_id)
        n = len(sizes)
        offsets = np.concatenate(([0], ends + np.arange(1, n + 1))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(pos, pos + n)),
                ids,
                pa.array(sizes + 1),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes)),
            ],
            ["part", "pos", "doc_id", "n_tokens", "ids"],
        )
        pos += n


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    blanks: str = "dropped",
    group_bytes: int = 32 << 20,
    page_rows: int = 512,
) -> None:
    """Write the ids of every whole text, with ``end_id`` after each, to Parquet.

    Rows lie in ascending ``doc_id`` order within and across files: ``docs`` are
    cut into ranges of ``doc_id`` (a sample of ids sets the bounds) and sorted
    inside each, before texts become ids, so ids are never shuffled. A row
    group holds about ``group_bytes`` and a page ``page_rows`` rows. Ids and
    ``part`` are dictionary-coded; ``pos``, ``doc_id`` and ``n_tokens`` are
    delta-coded. Row groups and pages carry minimum and maximum, so that a
    filter on ``doc_id`` reads only the pages it needs, and a read of the
    metadata columns touches no ids.

    A null text counts as empty: its document is the end id alone. Null ids come
    first. Rows that repeat an id stay next to each other. Other columns are not
    written. An empty table gives a folder without rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select("doc_id", "text")
        .repartitionByRange(max(parts, docs.rdd.getNumPartitions()), F.asc("doc_id"))
        .sortWithinPartitions("doc_id")
        .mapInArrow(
            functools.partial(_encode, path=tokenizer, blanks=blanks, end_id=end_id), FILE_SCHEMA
        )
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#part", "true")
        .option("parquet.block.size", str(group_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """The files of ``write_token_files``, with only the ``columns`` asked for."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return rows.select(*columns) if columns else rows


def _id_crcs(batches):
    for batch in batches:
        *keep, ids = batch.columns
        ends = ids.offsets.to_numpy()
        flat = ids.values.to_numpy().astype("<i4", copy=False)
        crcs = [zlib.crc32(flat[a:b].data) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(crcs, pa.int64())], ["part", "pos", "doc_id", "n_tokens", "ids_crc32"]
        )


def with_starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before a row, in file order.

    Sums run inside each part, which is as large as one file; only one number
    per part, from ``sizes`` (``part``, ``n_tokens``), meets in the window that
    ties the parts together.
    """
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        sizes.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return (
        rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .withColumn("start", F.col("start") + F.col("base"))
        .drop("base")
    )


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    rows = read_token_files(spark, path).mapInArrow(
        _id_crcs, "part int, pos bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sizes = read_token_files(spark, path, ["part", "n_tokens"])
    return with_starts(rows, sizes).select("doc_id", "start", "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/llm-{app}/{name}-{uuid.uuid4().hex}"
