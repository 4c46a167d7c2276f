"""Schemas of the stored tables."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

DOCUMENT = StructType(
    [
        StructField("doc_id", StringType()),
        StructField("url", StringType()),
        StructField("published_at", TimestampType()),
        StructField("fetched_at", TimestampType()),
        StructField("source", StringType()),
        StructField("source_url", StringType()),
        StructField("source_domain", StringType()),
        StructField("title", StringType()),
        StructField("body", StringType()),
        StructField("keyword_hits", ArrayType(StringType())),
        StructField("relevance_score", DoubleType()),
        StructField("query", StringType()),
    ]
)

DOCUMENT_SCORE = StructType(
    [
        StructField("doc_id", StringType()),
        StructField("model_name", StringType()),
        StructField("score", DoubleType()),
        StructField("label", StringType()),
        StructField("scored_at", StringType()),
    ]
)

# Provider payloads are read as text first: a field of the wrong kind is then
# null instead of a failed file.
TICKER_ARTICLES = (
    "array<struct<title: string, link: string, url: string, content: string, date: string, "
    "source: string, tags: array<string>, symbols: array<string>, "
    "sentiment: struct<polarity: string>>>"
)
SEARCH_ARTICLES = (
    "articles array<struct<title: string, url: string, description: string, content: string, "
    "publishedAt: string, source: struct<name: string, url: string>>>"
)
EVENT_ARTICLES = "articles array<struct<title: string, url: string, seendate: string, domain: string>>"

DAILY_BAR = (
    "symbol string, date string, open string, high string, low string, close string, "
    "adjusted_close string"
)
INTRADAY_BAR = (
    "symbol string, datetime string, timestamp string, open string, high string, low string, "
    "close string"
)
CALENDAR_ROW = "code string, date string, report_date string"
QUOTE = (
    "code string, close string, previousClose string, change string, change_p string, "
    "timestamp string"
)
CATALOG_ROW = "Code string, Name string, Type string"
