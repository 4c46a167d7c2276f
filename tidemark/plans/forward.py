"""Signals for coming events, and rescoring of stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.functions.signals import direction, heuristic_signal, position_weight, sign_dz
from tidemark.operators.market import live_pre_return
from tidemark.operators.model import FittedModel, predict
from tidemark.operators.news import news_features
from tidemark.operators.trades import swing_levels_plan
from tidemark.sources.calendar import upcoming_earnings


def apply_enhanced(rows: DataFrame, model: FittedModel | None = None) -> DataFrame:
    """Add enhanced sign, direction and confidence: by the model, else by momentum.

    ``rows`` holds the prior return and the news features.
    """
    if model is None:
        sign, confidence = heuristic_signal(
            F.col("baseline_pre_7d_return_pct"),
            F.col("enhanced_direct_mentions"),
            F.col("sent_mean_relevance"),
            F.col("enhanced_spillover_mentions"),
        )
        scored = rows.withColumns({"enhanced_pred_sign": sign, "enhanced_confidence": confidence})
    else:
        base = rows.withColumn("baseline_pre_7d_abs_return", F.abs("baseline_pre_7d_return_pct"))
        scored = predict(model, base).withColumns(
            {
                "enhanced_pred_sign": F.col("signal"),
                "enhanced_confidence": F.round("confidence", 4),
            }
        ).drop("signal", "confidence", "proba", "prediction")
    return scored.withColumn("enhanced_pred_direction", direction(F.col("enhanced_pred_sign")))


def rank_order() -> list[Column]:
    """Actionable first, then by confidence, then the nearest event."""
    return [
        F.col("actionable").desc(),
        F.col("confidence").desc(),
        F.col("days_to_earnings"),
        F.col("symbol"),
    ]


def paper_signals(
    universe: DataFrame,
    calendar: DataFrame,
    bars: DataFrame,
    docs: DataFrame,
    named: DataFrame,
    entities: DataFrame,
    edges: DataFrame,
    hedges: DataFrame,
    as_of: str,
    horizon_days: int = 14,
    min_confidence: float = fx.MIN_CONFIDENCE,
    model: FittedModel | None = None,
) -> DataFrame:
    """One row per coming event of the universe with its signal and levels."""
    coming = upcoming_earnings(calendar, as_of, horizon_days).join(
        universe.select("symbol", "name", "sector"), "symbol"
    )
    moves = live_pre_return(bars, as_of).where(F.col("pre_7d_return_pct").isNotNull())
    rows = coming.join(moves, "symbol").withColumn(
        "baseline_pre_7d_return_pct", F.col("pre_7d_return_pct")
    )
    news = news_features(coming, docs, named, entities, edges)
    scored = apply_enhanced(rows.join(news, ["symbol", "t_event"], "left"), model)
    sign = F.when(F.col("enhanced_pred_sign") != 0, F.col("enhanced_pred_sign")).otherwise(
        sign_dz(F.col("baseline_pre_7d_return_pct"), fx.SIGNAL_DEAD_ZONE)
    )
    day = F.lit(as_of).cast("date")
    planned = swing_levels_plan(
        scored.withColumns(
            {
                "signal": sign,
                "entry": F.when(F.col("last_d") >= F.date_sub(day, 5), F.col("spot")),
                "predicted_move": F.col("baseline_pre_7d_return_pct"),
                "vol": F.lit(None).cast("double"),
            }
        ),
        hedges,
        universe,
    )
    return planned.select(
        "symbol",
        "name",
        "sector",
        "t_event",
        F.greatest(F.lit(0), F.date_diff(F.to_date("t_event"), day)).alias("days_to_earnings"),
        "signal",
        direction(F.col("signal")).alias("direction"),
        F.round("enhanced_confidence", 4).alias("confidence"),
        position_weight(F.col("enhanced_confidence")).alias("position_weight"),
        F.round("baseline_pre_7d_return_pct", 4).alias("baseline_pre_7d_return_pct"),
        "sent_doc_count",
        "spillover_mentions_7d",
        ((F.col("signal") != 0) & (F.col("enhanced_confidence") >= min_confidence)).alias(
            "actionable"
        ),
        "entry_price",
        "stop_price",
        "target_price",
        "suggested_hedge",
    )


def rank_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy(*rank_order())
