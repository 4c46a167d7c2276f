"""The event row grows by joins: label, news, signal, path, market features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.functions.signals import direction, heuristic_signal, num0_columns
from tidemark.operators.market import baseline_events, enrich_events, market_features
from tidemark.operators.news import news_features
from tidemark.operators.trades import trade_paths
from tidemark.session import cut_lineage

_ON = ["symbol", "t_event"]


def apply_heuristic(events: DataFrame, features: DataFrame) -> DataFrame:
    """Events with their news features and the momentum signal."""
    rows = events.join(features, _ON, "left")
    sign, confidence = heuristic_signal(
        F.col("baseline_pre_7d_return_pct"),
        F.col("enhanced_direct_mentions"),
        F.col("sent_mean_relevance"),
        F.col("enhanced_spillover_mentions"),
    )
    return rows.withColumns(
        {
            "enhanced_pred_sign": sign,
            "enhanced_pred_direction": direction(sign),
            "enhanced_confidence": confidence,
        }
    )


def labelled(events: DataFrame) -> DataFrame:
    """Events fit for training: a symbol, a time, and a label that is not flat."""
    return events.where(
        (F.trim("symbol") != "") & F.col("t_event").isNotNull() & (F.col("actual_sign") != 0)
    ).withColumn("label", (F.col("actual_sign") > 0).cast("int"))


def feature_frame(events: DataFrame) -> DataFrame:
    """Model inputs of labelled events; missing features are 0."""
    rows = labelled(events).withColumn(
        "baseline_pre_7d_abs_return", F.abs("baseline_pre_7d_return_pct")
    )
    rows = num0_columns(rows, fx.ENHANCED_FEATURES)
    kept = [c for c in ("baseline_pred_sign", "enhanced_pred_sign", "enhanced_confidence") if c in rows.columns]
    return rows.select(*_ON, "label", "actual_sign", "actual_5d_return_pct", *kept, *fx.ENHANCED_FEATURES)


def evaluate_events(
    calendar: DataFrame,
    bars: DataFrame,
    docs: DataFrame,
    named: DataFrame,
    entities: DataFrame,
    company: DataFrame,
    edges: DataFrame,
    hedges: DataFrame | None = None,
) -> DataFrame:
    """All columns of the calendar's events.

    Market features are joined before any model scores them. Bars and labels
    feed many joins, so both are written once.
    """
    bars = cut_lineage(bars)
    base = cut_lineage(baseline_events(calendar, bars))
    market = market_features(base, bars, calendar, company, edges)
    with_market = enrich_events(base, market)
    rows = apply_heuristic(with_market, news_features(base, docs, named, entities, edges))
    if hedges is None:
        return rows
    paths = trade_paths(rows, bars, hedges, company)
    added = [c for c in paths.columns if c not in rows.columns]
    return rows.join(paths.select(*_ON, *added), _ON, "left")
