"""Yearly anchor events, the news before them, and spillover along edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core import asof_join, interval_join, top_by
from tidemark.functions.signals import pct_change
from tidemark.functions.text import tanh_sentiment


def annual_anchors(calendar: DataFrame, years_back: int = 5) -> DataFrame:
    """Latest event of each year, for each symbol's last ``years_back`` years.

    One row per (symbol, year) reaches the window.
    """
    yearly = calendar.groupBy("symbol", F.year("t_event").alias("event_year")).agg(
        F.max("t_event").alias("anchor")
    )
    newest = Window.partitionBy("symbol").orderBy(F.col("event_year").desc())
    return (
        yearly.withColumn("age", F.row_number().over(newest))
        .where(F.col("age") <= years_back)
        .drop("age")
    )


def anchor_returns(
    anchors: DataFrame, bars: DataFrame, pre_days: int = 30, post_days: int = 20
) -> DataFrame:
    """Return into and after each anchor; all three bars must exist.

    A bar counts if it lies in the span from 7 days before the pre-window to 7
    days after the post-window.
    """
    on = F.to_date("anchor")
    base = anchors.withColumns(
        {
            "pre_window_start": F.date_sub(on, pre_days),
            "anchor_date": on,
            "post_window_end": F.date_add(on, post_days),
        }
    )
    closes = bars.select("symbol", "d", "close")
    rows = base
    for name, at in (("p0", "pre_window_start"), ("pa", "anchor_date"), ("p5", "post_window_end")):
        rows = asof_join(rows, closes, event_ts=at, how="left").withColumnsRenamed(
            {"close": name, "d": f"{name}_d"}
        )
    far = F.date_add("post_window_end", 7)
    usable = (F.col("p5_d") <= far) & (F.col("p0") != 0) & (F.col("pa") != 0) & (F.col("p5") != 0)
    post = pct_change(F.col("pa"), F.col("p5"))
    return rows.select(
        F.concat_ws("_", "symbol", F.col("anchor_date").cast("string")).alias("event_id"),
        "symbol",
        "event_year",
        "anchor",
        "anchor_date",
        "pre_window_start",
        "post_window_end",
        F.when(usable, F.round(pct_change(F.col("p0"), F.col("pa")), 4)).alias("pre_return_pct"),
        F.when(usable, F.round(post, 4)).alias("post_return_pct"),
        F.when(usable, F.signum(post).cast("int")).otherwise(F.lit(0)).alias("target_sign"),
    )


def anchor_news(
    anchors: DataFrame,
    articles: DataFrame,
    pre_days: int = 30,
    most: int = 25,
    positive: Sequence[str] = fx.ANNUAL_POSITIVE,
    negative: Sequence[str] = fx.ANNUAL_NEGATIVE,
    ai: Sequence[str] = fx.ANNUAL_AI,
) -> DataFrame:
    """The newest ``most`` articles of each symbol's pre-window, with sentiment.

    ``articles`` holds (doc_id, symbol, doc_ts, title, body). Texts are scored
    before the join; only numbers travel.
    """
    score, hits = tanh_sentiment(F.col("title"), F.col("body"), positive, negative, ai)
    scored = articles.select(
        "symbol", "doc_id", "doc_ts", score.alias("sentiment_score"), hits.alias("ai_term_hits")
    )
    # The window closes with the anchor's day, not at its hour.
    closing = anchors.select(
        "event_id",
        "symbol",
        (F.date_add("anchor_date", 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")).alias(
            "t_event"
        ),
        "pre_window_start",
    )
    newest = [F.col("doc_ts").desc(), F.col("doc_id")]
    # Windows are whole days, so no day gives an event more than its newest ``most``.
    daily = top_by(
        scored.where(F.col("doc_ts").isNotNull()).withColumn("__on", F.to_date("doc_ts")),
        ["symbol", "__on"],
        newest,
        most,
    ).drop("rank", "__on")
    pairs = interval_join(
        closing, daily, fact_ts="doc_ts", days=pre_days + 1, by=["symbol"]
    ).where(F.to_date("doc_ts") >= F.col("pre_window_start"))
    return top_by(pairs, ["event_id"], newest, most).select(
        "event_id", "symbol", "doc_id", "doc_ts", "sentiment_score", "ai_term_hits"
    )


def annual_events(returns: DataFrame, news: DataFrame) -> DataFrame:
    """Anchors with the count, mean sentiment and AI hits of their articles."""
    sums = news.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("news_count"),
        F.avg("sentiment_score").alias("mean"),
        F.sum("ai_term_hits").alias("ai"),
    )
    return (
        returns.join(sums, "event_id", "left")
        .withColumns(
            {
                "news_count": F.coalesce("news_count", F.lit(0)),
                "mean_sentiment": F.round(F.coalesce("mean", F.lit(0.0)), 6),
                "ai_term_hits": F.coalesce("ai", F.lit(0)),
            }
        )
        .drop("mean", "ai", "anchor")
    )


def spillover_effects(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Each event's mean sentiment along its symbol's outgoing edges."""
    out = edges.select(
        F.col("src").alias("symbol"), F.col("dst").alias("target_symbol"), "weight"
    )
    return events.join(out, "symbol").select(
        "event_id",
        F.col("symbol").alias("source_symbol"),
        "target_symbol",
        F.col("weight").alias("edge_weight"),
        F.round(F.col("mean_sentiment") * F.col("weight"), 6).alias("spillover_score"),
    )
