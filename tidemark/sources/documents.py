"""Document table, JSON-lines snapshots, event files and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators.documents import event_time


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored documents with a usable time, oldest first within each file."""
    return event_time(spark.read.schema(schema.DOCUMENT).format(fmt).load(path))


def in_time_order(docs: DataFrame) -> DataFrame:
    """Documents range-partitioned and sorted by time."""
    return docs.orderBy("doc_ts", "doc_id")


def write_documents(docs: DataFrame, path: str, mode: str = "append", salts: int = 8) -> None:
    """Parquet partitioned by the month of the event time, so that time filters prune.

    Rows of one month meet in ``salts`` tasks, which bounds both the number of
    files and the share of a busy month that one task writes.
    """
    at = F.coalesce(F.col("published_at"), F.col("fetched_at"))
    (
        docs.withColumn("event_month", F.date_format(at, "yyyy-MM"))
        .repartition("event_month", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .write.mode(mode)
        .partitionBy("event_month")
        .parquet(path)
    )


def write_snapshot(docs: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are written."""
    docs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_snapshot(spark: SparkSession, path: str, doc_schema=schema.DOCUMENT) -> DataFrame:
    return spark.read.schema(doc_schema).json(path)


def keyword_list(raw: F.Column) -> F.Column:
    """JSON list of strings; anything else is an empty list."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(raw, "array<string>"), empty)


def read_events(spark: SparkSession, path: str, event_fields: str) -> DataFrame:
    """Event rows of landed result files: a header with an ``events`` array."""
    files = spark.read.text(path, wholetext=True)
    return parse_events(files, event_fields)


def parse_events(files: DataFrame, event_fields: str, text: str = "value") -> DataFrame:
    """Objects of each text's ``events`` array; other array members drop out."""
    members = F.from_json(F.col(text), "struct<events: array<string>>")["events"]
    return (
        files.select(F.explode(members).alias("event"))
        .where(F.trim("event").startswith("{"))
        .select(F.from_json("event", f"struct<{event_fields}>").alias("e"))
        .select("e.*")
    )


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("ignoreNullFields", "false") if fmt == "json" else writer).format(fmt).save(path)
