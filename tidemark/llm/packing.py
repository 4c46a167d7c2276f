"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import functools
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import encoder
from tidemark.llm.common import stored, text_slices

#: Fixed value: bytes of text that are encoded at once.
TEXT_BYTES = 2 << 20
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _pieces(batches, path, blanks, end_id, window, keep_ids):
    for batch in text_slices(batches, 1, 2048, TEXT_BYTES):
        ids, texts = batch.columns
        codes, sizes = encoder(path, blanks).encode_flat(texts)
        codes = np.insert(codes.astype("<u4", copy=False), np.cumsum(sizes), end_id)
        sizes = sizes + 1
        parts = -(-sizes // window)
        doc = np.repeat(np.arange(len(sizes)), parts)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
        length = np.minimum(sizes[doc] - start, window)
        ends = np.concatenate(([0], np.cumsum(length)))
        crcs = [zlib.crc32(codes[a:b].data) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        columns = {
            "doc_id": ids.cast(pa.int64()).take(pa.array(doc)),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids_crc32": pa.array(crcs, pa.int64()),
            "doc_tokens": pa.array(sizes[doc]),
        }
        if keep_ids:
            offsets = pa.array(ends.astype(np.int32))
            columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(columns)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    window: int = 1024,
    blanks: str = "kept",
    keep_ids: bool = False,
) -> DataFrame:
    """Token ids of each whole text and ``end_id``, cut every ``window`` ids.

    Per piece: ``doc_id``, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` and, with ``keep_ids``, the ``ids``.
    """
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(
            _pieces, path=tokenizer, blanks=blanks, end_id=end_id, window=window, keep_ids=keep_ids
        ),
        schema,
    )


def _target(reach: int, window: int) -> int:
    """The sum with the least padding: a full window, else a power of two, else the largest."""
    while window:
        if reach >> window & 1:
            return window
        window //= 2
    return reach.bit_length() - 1


def fullest(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths that holds the largest one and leaves the least padding.

    Sequences are padded to the window, except at a power of two (the window is
    one), so a sum that is a power of two leaves none.
    Subset sums are bits of an integer: after each length, bit ``s`` tells
    whether sum ``s`` can be made with the copies at hand. The search stops as
    soon as the window can be filled; the counts are read back from the saved
    bitsets, last length first.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    mask = (1 << (window + 1)) - 1
    reach = 1 << lengths[0]
    saved = []
    for length in lengths:
        saved.append(reach)
        spare = counts[length] - (length == lengths[0])
        step = reach
        for _ in range(min(spare, window // length)):
            step = (step << length) & mask
            if not step:
                break
            reach |= step
        if reach >> window & 1:
            break
    total = _target(reach, window)
    chosen: dict[int, int] = defaultdict(int)
    chosen[lengths[0]] = 1
    for length, before in zip(reversed(lengths[: len(saved)]), reversed(saved)):
        while not before >> total & 1:
            total -= length
            chosen[length] += 1
    return dict(chosen)


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Local sequence number and offset of each piece of one shard.

    A filling that was found is used as often as the remaining counts allow.
    """
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        waiting[int(lengths[i])].append(i)
    counts = {n: len(rows) for n, rows in waiting.items()}
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    used = 0
    while counts:
        chosen = fullest(counts, window)
        for _ in range(min(counts[n] // c for n, c in chosen.items())):
            at = 0
            for n, c in chosen.items():
                for _ in range(c):
                    i = waiting[n].pop()
                    sequence[i], offset[i] = used, at
                    at += n
            used += 1
        counts = {n: len(rows) for n, rows in waiting.items() if rows}
    return sequence, offset


def _pack_shard(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["row"], ignore_index=True)
    sequence, offset = place(pdf["length"].to_numpy(), window)
    shard = pdf["shard"].to_numpy(np.int64)
    return pd.DataFrame(
        {"row": pdf["row"], "sequence_id": ((shard << 32) + sequence) * 2 + 1, "offset": offset}
    )


def pack(cut: DataFrame, window: int = 1024, shard_rows: int = 16384) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``pieces``.

    A piece of ``window`` ids is a sequence of its own. The others are dealt
    evenly to shards of about ``shard_rows`` pieces by a hash of their place in
    the stored table, so that no document or repeated row makes a shard large,
    and every shard is packed by minimum bin slack: the largest piece that
    remains goes with the multiset of others that fills the window best. Only
    the last sequences of a shard are padded; nothing is dropped. Only
    (row, length) is shuffled.

    Repeated rows and null ids are pieces like any other. An empty table gives
    an empty result.
    """
    rows = stored(cut, "pieces").withColumn("row", F.monotonically_increasing_id())
    full = rows.where(F.col("length") == window).select(
        *cut.columns, (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    part = rows.where(F.col("length") < window)
    shards = max(1, math.ceil(part.count() / shard_rows))
    placed = (
        part.select("row", "length")
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(
            lambda pdf: _pack_shard(pdf, window), "row bigint, sequence_id bigint, offset bigint"
        )
    )
    return full.unionByName(part.join(placed, "row").drop("row"))


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024
) -> DataFrame:
    """Pack all documents: one row per piece, as ``pieces`` and ``pack`` give them.

    A null text counts as empty: its document is the end id alone.
    """
    return pack(pieces(docs, tokenizer, end_id, window), window)
