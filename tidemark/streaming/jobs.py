"""Streaming ingest, rolling mentions and bars; idempotent per batch.

A batch that is run again after a lost driver leaves the same rows: stores know
the numbers of the batches they hold.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark import fixed_values as fx
from tidemark.operators.documents import dedupe_documents, ensure_scores, mentions
from tidemark.session import shared_dir
from tidemark.streaming.keyed import KeyedStore
from tidemark.streaming.versions import VersionedTable

_PARTITIONS = "spark.sql.shuffle.partitions"
_STARTING = threading.Lock()
MENTION_KEYS = ("window_end", "alias")
BAR_KEYS = ("symbol", "start")
SCORES = "doc_id string, model_name string, score double, label string, scored_at string"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
           mode: str = "append", state_partitions: int | None = None) -> StreamingQuery:
    """Run over what has landed. A stream keeps the number of state partitions
    that the session had at its first start; ``state_partitions`` sets it. A
    stream copies the settings when it starts, and starts take turns."""
    spark = df.sparkSession
    with _STARTING:
        usual = spark.conf.get(_PARTITIONS)
        if state_partitions:
            spark.conf.set(_PARTITIONS, str(state_partitions))
        try:
            return (
                df.writeStream.outputMode(mode)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .foreachBatch(write)
                .start()
            )
        finally:
            spark.conf.set(_PARTITIONS, usual)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store at ``path``."""
    return KeyedStore(spark, path).read()


def ingest_stream(
    articles: DataFrame,
    gate: Callable[[DataFrame], DataFrame],
    store: str,
    scores: str,
    scorer: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    model: str = fx.LEXICON_MODEL,
    buckets: int = 16,
    bucket_rows: int = 100_000,
) -> StreamingQuery:
    """Landed articles to new documents and their scores.

    Copies inside a batch are dropped by an aggregation, those of any earlier
    batch by the store, however late they arrive; the stream keeps no state, so
    late articles are not lost. A batch opens only the buckets of the stores
    that may hold its URLs, and the stores get more buckets as they grow.
    """
    spark = articles.sparkSession
    gated = gate(articles).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    documents = KeyedStore.create(spark, store, ["url"], gated.schema, buckets, bucket_rows)
    scored = KeyedStore.create(
        spark, scores, ["doc_id", "model_name"], SCORES, buckets, bucket_rows
    )

    def write(batch: DataFrame, number: int) -> None:
        for held in (documents, scored):
            if held.crowded():
                held.reorganise()
        token = f"{checkpoint}#{number}"
        at, scored_at = documents.number_of(token), scored.number_of(token)
        arrived = _landed(dedupe_documents(batch), f"{store}/arrived", number)
        fresh = documents.put(documents.missing(arrived, at), at, token)
        named = fresh.select("doc_id", "title", "body", F.lit(model).alias("model_name"))
        todo = scored.missing(named, scored_at).drop("model_name")
        none = spark.createDataFrame([], SCORES)
        scored.put(ensure_scores(todo, none, model, scorer, str(number)), scored_at, token)

    return _start(gated, write, checkpoint)


def _landed(rows: DataFrame, path: str, number: int) -> DataFrame:
    """Rows of a micro-batch, written once for all that read them, in place of the last one's."""
    place = f"{path}/{number % 2}"
    rows.write.mode("overwrite").parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def _changes(
    log: VersionedTable, keys: Sequence[str], most: int, checkpoint: str
) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        log.append(batch, f"{checkpoint}#{number}")
        if log.deltas() > most:
            compact(log, keys)

    return write


def update_log(spark: SparkSession, path: str, schema) -> VersionedTable:
    """The log of updates at ``path``: a base, and a folder per micro-batch since."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    return VersionedTable(spark, path, type(schema)([*schema.fields]).add("batch", "long"))


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch").alias("v"))
        .select(*keys, "v.*")
    )


def current(log: VersionedTable, keys: Sequence[str]) -> DataFrame:
    """Latest state of each key: the base and the updates since."""
    return _newest(log.read(), keys).drop("batch")


def compact(log: VersionedTable, keys: Sequence[str], keep: int = 2) -> None:
    """Put the latest state of each key in place of the base and its updates."""
    log.compact(lambda rows: _newest(rows, keys))
    log.vacuum(keep)


def mentions_stream(docs: DataFrame, aliases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Arriving documents to stored mention rows; ``docs`` holds doc_ts and lex."""

    def write(batch: DataFrame, number: int) -> None:
        mentions(batch, aliases, keep=["doc_ts", "lex"]).write.mode(
            "overwrite"
        ).parquet(f"{path}/batch={number}")

    return _start(docs, write, checkpoint)


def rolling_mentions(named: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Mentions and mean polarity per alias over 7 days, sliding by a day.

    Works on a stream or a table of mention rows.
    """
    timed = named.withColumn("ts", F.col("doc_ts").cast("timestamp"))
    if named.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    span = F.window("ts", "7 days", "1 day")
    return (
        timed.groupBy(span.alias("w"), "alias")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            F.sum("by_ticker").alias("ticker_mentions"),
            F.avg("lex").alias("mean_lex"),
        )
        .select(
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "alias",
            "mentions",
            "ticker_mentions",
            "mean_lex",
        )
    )


def rolling_mentions_stream(named: DataFrame, path: str, checkpoint: str,
                            state_partitions: int | None = None, most: int = 8) -> StreamingQuery:
    """Windows to the update log at ``path``, compacted after ``most`` batches."""
    rows = rolling_mentions(named)
    write = _changes(update_log(named.sparkSession, path, rows.schema), MENTION_KEYS, most, checkpoint)
    return _start(rows, write, checkpoint, "update", state_partitions)


def bars_from_ticks(ticks: DataFrame, width: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Open, high, low and close per symbol and window, of a stream or a table."""
    timed = ticks.withColumn("at", F.col("ts").cast("timestamp"))
    if ticks.isStreaming:
        timed = timed.withWatermark("at", watermark)
    return (
        timed.groupBy(F.window("at", width).alias("w"), "symbol")
        .agg(
            F.min_by("price", "at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "at").alias("close"),
        )
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close")
    )


def bars_stream(ticks: DataFrame, path: str, checkpoint: str, width: str = "1 day",
                state_partitions: int | None = None, most: int = 8) -> StreamingQuery:
    """Bars to the update log at ``path``, compacted after ``most`` batches."""
    rows = bars_from_ticks(ticks, width)
    write = _changes(update_log(ticks.sparkSession, path, rows.schema), BAR_KEYS, most, checkpoint)
    return _start(rows, write, checkpoint, "update", state_partitions)


def current_mentions(spark: SparkSession, path: str) -> DataFrame:
    """The windows that ``rolling_mentions_stream`` keeps at ``path``."""
    schema = (
        "window_end timestamp_ntz, alias string, mentions long, ticker_mentions long, mean_lex double"
    )
    return current(update_log(spark, path, schema), MENTION_KEYS)


def current_bars(spark: SparkSession, path: str, price: str = "double") -> DataFrame:
    """The bars that ``bars_stream`` keeps at ``path``; ``price`` is the type of the ticks' prices."""
    prices = ", ".join(f"{c} {price}" for c in ("open", "high", "low", "close"))
    return current(update_log(spark, path, f"symbol string, start timestamp_ntz, {prices}"), BAR_KEYS)


def backfill_table(spark: SparkSession, store: str, schema) -> VersionedTable:
    """The table of backfilled documents at ``store``; ``schema`` is that of the documents."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    return VersionedTable(spark, store, type(schema)([*schema.fields]).add("slice", "date"), ["slice"])


def backfill(docs: DataFrame, store: str, start: str, end: str, chunk_days: int = 14) -> None:
    """Add documents of ``[start, end)`` in slices of ``chunk_days``, one job.

    Slices are counted from 1970-01-01, so all runs over a store line up (with
    one ``chunk_days``). Only URLs that no slice holds yet are added, in files of
    their own, so any order of ranges, shorter, shifted or repeated, leaves one
    row per URL. Stored files are never touched: a version that names the new
    ones is published last, and a run that broke off before can be run again.
    """
    on = F.to_date("doc_ts")
    days = F.unix_date(on)
    table = backfill_table(docs.sparkSession, store, docs.schema)
    wanted = docs.where(
        (on >= F.lit(start).cast("date")) & (on < F.lit(end).cast("date"))
    ).withColumn("slice", F.date_from_unix_date((F.floor(days / chunk_days) * chunk_days).cast("int")))
    fresh = dedupe_documents(wanted, table.read(), order=("doc_ts", "title"))
    table.append(fresh.repartition("slice", F.pmod(F.xxhash64("url"), F.lit(8))))


def merge_backfills(spark: SparkSession, store: str, schema, keep: int = 2) -> None:
    """Put one folder per slice in place of those of many backfills."""
    table = backfill_table(spark, store, schema)
    table.compact(lambda rows: rows.repartition("slice", F.pmod(F.xxhash64("url"), F.lit(8))))
    table.vacuum(keep)
