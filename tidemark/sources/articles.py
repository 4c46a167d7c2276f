"""Landed article payloads and feeds to article rows.

Readers take the files a fetcher has landed; ``parse_*`` take a column of
payload text, for streams and tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import text as tx
from tidemark.functions.urls import domain


def _iso(raw: Column) -> Column:
    return tx.parse_ts(raw).cast("timestamp_ntz")


def parse_ticker_articles(payloads: DataFrame, text: str = "value", symbol: str = "symbol") -> DataFrame:
    """One JSON array of articles per row, fetched for the row's symbol."""
    found = F.explode(F.from_json(F.col(text), schema.TICKER_ARTICLES))
    return payloads.select(F.col(symbol).alias("symbol"), found.alias("a")).select(
        "symbol",
        F.coalesce(F.nullif("a.link", F.lit("")), "a.url").alias("url"),
        F.col("a.title").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("a.content").alias("content"),
        F.col("a.source").alias("source"),
        F.lit(None).cast("string").alias("source_url"),
        _iso(F.col("a.date")).alias("published_at"),
        F.col("a.tags").alias("tags"),
        F.col("a.symbols").alias("symbols"),
        F.coalesce(F.col("a.sentiment.polarity").try_cast("double"), F.lit(0.0)).alias("polarity"),
    )


def parse_search_articles(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Search API payloads: an object with an array of articles."""
    found = F.explode(F.from_json(F.col(text), schema.SEARCH_ARTICLES)["articles"])
    return payloads.select(found.alias("a")).select(
        F.col("a.url").alias("url"),
        F.col("a.title").alias("title"),
        F.col("a.description").alias("description"),
        F.col("a.content").alias("content"),
        F.col("a.source.name").alias("source"),
        F.nullif(F.col("a.source.url"), F.lit("")).alias("source_url"),
        _iso(F.col("a.publishedAt")).alias("published_at"),
    )


def parse_event_articles(payloads: DataFrame, query: Column, text: str = "value") -> DataFrame:
    """Event API payloads: only a title, a compact time and a domain.

    The query the payload answers stands in for the missing text.
    """
    found = F.explode(F.from_json(F.col(text), schema.EVENT_ARTICLES)["articles"])
    body = tx.compact_text(F.concat_ws(" ", F.coalesce("a.title", F.lit("")), F.col("query")))
    return payloads.select(query.alias("query"), found.alias("a")).select(
        tx.compact_text(F.col("a.url")).alias("url"),
        tx.compact_text(F.col("a.title")).alias("title"),
        body.alias("description"),
        body.alias("content"),
        F.coalesce(F.nullif(tx.compact_text(F.col("a.domain")), F.lit("")), F.lit("event_news")).alias(
            "source"
        ),
        F.lit(None).cast("string").alias("source_url"),
        tx.parse_compact_ts(tx.compact_text(F.col("a.seendate"))).cast("timestamp_ntz").alias(
            "published_at"
        ),
        "query",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON files, one payload per file, with the file's path."""
    return spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path")
    )


_ITEM = (
    "title string, link string, description string, `content:encoded` string, encoded string, "
    "pubDate string"
)
_ENTRY = (
    "title string, summary string, content string, updated string, "
    "link array<struct<_href: string>>"
)


def _feed_rows(df: DataFrame, columns: dict[str, Column], feed: Column) -> DataFrame:
    cleaned = df.select(
        *[tx.compact_text(c).alias(name) for name, c in columns.items()],
        feed.alias("source_url"),
    ).where(F.col("url") != "")
    return cleaned.select(
        "url",
        "title",
        "description",
        "content",
        domain(F.col("source_url")).alias("source"),
        "source_url",
        _iso(F.col("published")).alias("published_at"),
    )


def _not_before(rows: DataFrame, since) -> DataFrame:
    """Rows without a date stay."""
    if since is None:
        return rows
    at = F.lit(since).cast("timestamp_ntz")
    return rows.where(F.col("published_at").isNull() | (F.col("published_at") >= at))


def read_feeds(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Landed RSS or Atom files to article rows; entries only where no items are.

    The file's path stands for the feed's address.
    """
    feed = F.col("_metadata.file_path")
    xml = spark.read.format("xml").option("nullValue", "").option("ignoreNamespace", "true")
    items = _feed_rows(
        xml.option("rowTag", "item").schema(_ITEM).load(path),
        {
            "url": F.col("link"),
            "title": F.col("title"),
            "description": F.col("description"),
            "content": F.coalesce("encoded", F.col("`content:encoded`")),
            "published": F.col("pubDate"),
        },
        feed,
    )
    href = F.filter("link._href", lambda h: F.coalesce(F.trim(h), F.lit("")) != "")
    entries = _feed_rows(
        xml.option("rowTag", "entry").schema(_ENTRY).load(path),
        {
            "url": F.get(href, F.lit(0)),
            "title": F.col("title"),
            "description": F.col("summary"),
            "content": F.col("content"),
            "published": F.col("updated"),
        },
        feed,
    )
    only_entries = entries.join(items.select("source_url").distinct(), "source_url", "left_anti")
    return _not_before(items.unionByName(only_entries), since)


def parse_feeds(feeds: DataFrame, xml: str = "xml", feed: str = "feed_url", since=None) -> DataFrame:
    """RSS or Atom text in a column to article rows, as ``read_feeds``."""

    def nodes(tag: str) -> Column:
        return F.regexp_extract_all(
            F.regexp_replace(F.col(xml), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""),
            F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"),
            F.lit(0),
        )

    listed = feeds.select(F.col(feed).alias("feed_url"), nodes("item").alias("items"),
                          nodes("entry").alias("entries"))
    is_rss = F.size("items") > 0
    rows = listed.select(
        "feed_url",
        is_rss.alias("rss"),
        F.explode(F.when(is_rss, F.col("items")).otherwise(F.col("entries"))).alias("node"),
    ).withColumn("node", F.regexp_replace("node", r"<(/?)\w+:(\w+)", "<$1$2"))

    def field(tag: str) -> Column:
        """Text of the first ``tag`` child, entities and CDATA resolved."""
        raw = F.regexp_extract("node", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        inner = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            inner = F.replace(inner, F.lit(entity), F.lit(char))
        return inner

    href = F.replace(F.regexp_extract("node", r"<link[^>]*\shref=\"([^\"]+)\"", 1), F.lit("&amp;"), F.lit("&"))
    return _not_before(
        _feed_rows(
            rows,
            {
                "url": F.when(F.col("rss"), field("link")).otherwise(href),
                "title": field("title"),
                "description": F.when(F.col("rss"), field("description")).otherwise(field("summary")),
                "content": F.when(F.col("rss"), field("encoded")).otherwise(field("content")),
                "published": F.when(F.col("rss"), field("pubDate")).otherwise(field("updated")),
            },
            F.col("feed_url"),
        ),
        since,
    )
