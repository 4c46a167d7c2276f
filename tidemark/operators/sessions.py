"""Signals gathered into trading sessions, and the metrics of those sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core import asof_join
from tidemark.core.ordering import growth_summary
from tidemark.functions.signals import clamp, confidence_bucket, direction, pct_change
from tidemark.operators.trades import _count, _ratio, _side_by_side


def filter_signals(
    events: DataFrame,
    symbols: DataFrame | None = None,
    require_news: bool = False,
    min_confidence: float = fx.OVERLAY_MIN_CONFIDENCE,
) -> DataFrame:
    """Events of a subset; a signal below the floor becomes 0 but stays counted."""
    kept = events
    if symbols is not None:
        kept = kept.withColumn("symbol", F.upper("symbol")).join(
            symbols.select(F.upper("symbol").alias("symbol")).distinct(), "symbol", "left_semi"
        )
    if require_news:
        kept = kept.where(F.coalesce(F.col("sent_doc_count"), F.lit(0)) > 0)
    sign = F.coalesce(F.col("enhanced_pred_sign"), F.lit(0))
    conf = F.coalesce(F.col("enhanced_confidence"), F.lit(0.0))
    return kept.withColumns(
        {
            "enhanced_confidence": conf,
            "enhanced_pred_sign": F.when(conf < min_confidence, F.lit(0)).otherwise(sign),
        }
    )


def assign_session(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Next session strictly after the event's date; later events drop out."""
    one = F.lit(0)
    return asof_join(
        events.withColumn("__m", one),
        calendar.select(F.col("d").alias("session_date")).distinct().withColumn("__m", one),
        by=["__m"],
        bar_date="session_date",
        strict=True,
    ).drop("__m")


def _signal_sums(signals: DataFrame, session: str, mode: str) -> DataFrame:
    part = F.col("sign") * F.col("confidence")
    if mode == "cap":
        part = part * F.coalesce(F.col("weight"), F.lit(0.0))
    return signals.groupBy(session).agg(
        # Added up as decimals: signals that cancel give exactly 0.
        F.sum(part.cast("decimal(28,10)")).alias("agg"),
        F.sum(F.abs(F.coalesce(F.col("weight"), F.lit(0.0)))).alias("weight_sum"),
        F.count(F.lit(1)).alias("n_events"),
        F.array_sort(F.collect_set("symbol")).alias("symbols"),
    )


def build_sessions(signals: DataFrame, index_bars: DataFrame, mode: str = "equal") -> DataFrame:
    """One row per session that signals agree on, with its directional return.

    ``signals`` holds symbol, t_event, sign, confidence, weight (used in mode
    "cap"); rows with sign 0 are ignored.
    """
    live = signals.where(F.col("sign") != 0)
    sums = _signal_sums(assign_session(live, index_bars), "session_date", mode).withColumn(
        "agg", F.col("agg").cast("double")
    )
    bars = index_bars.where((F.col("open") != 0) & F.col("close").isNotNull()).select(
        F.col("d").alias("session_date"), "open", "close"
    )
    side = F.when(F.col("agg") > 0, F.lit(1)).otherwise(F.lit(-1))
    ret = pct_change(F.col("open"), F.col("close"))
    return (
        sums.where(F.col("agg") != 0)
        .join(bars, "session_date")
        .select(
            "session_date",
            side.alias("direction"),
            F.round("agg", 4).alias("agg_score"),
            "n_events",
            "symbols",
            confidence_bucket(F.abs("agg") / F.col("n_events")).alias("confidence_bucket"),
            F.round("open", 4).alias("open"),
            F.round("close", 4).alias("close"),
            F.round(ret, 4).alias("session_return_pct"),
            F.round(side * ret, 4).alias("directional_return_pct"),
            (side * ret > 0).alias("hit"),
        )
    )


def upcoming_sessions(
    signals: DataFrame,
    calendar: DataFrame,
    floor: float = fx.OVERLAY_MIN_CONFIDENCE,
    raw: bool = False,
) -> DataFrame:
    """Cap-weighted bias per coming session of an explicit calendar.

    ``avg_confidence`` is the weighted mean confidence; ``raw=True`` divides by
    the number of signals instead, without normalising the weights.
    """
    placed = assign_session(signals.where(F.col("sign") != 0), calendar)
    sums = _signal_sums(placed, "session_date", "cap").withColumn(
        "agg", F.col("agg").cast("double")
    )
    divisor = F.col("n_events").cast("double") if raw else F.col("weight_sum")
    avg = F.coalesce(F.when(divisor > 0, F.abs("agg") / divisor), F.lit(0.0))
    sign = F.signum("agg").cast("int")
    listed = placed.groupBy("session_date").agg(
        F.array_sort(
            F.collect_list(F.struct("symbol", "t_event", "sign", "confidence"))
        ).alias("contributors")
    )
    return sums.join(listed, "session_date").select(
        "session_date",
        F.round("agg", 4).alias("aggregated_signed_confidence"),
        direction(sign, "trade").alias("direction"),
        sign.alias("direction_sign"),
        F.col("n_events").alias("n_contributing_events"),
        F.round(avg, 4).alias("avg_confidence"),
        ((sign != 0) & (avg >= floor)).alias("actionable"),
        "contributors",
    )


def session_bias(signals: DataFrame, floor: float = fx.OVERLAY_MIN_CONFIDENCE,
                 raw: bool = False) -> DataFrame:
    """The one cap-weighted bias of all current signals."""
    sums = _signal_sums(
        signals.where(F.col("sign") != 0).withColumn("__all", F.lit(1)), "__all", "cap"
    ).withColumn("agg", F.col("agg").cast("double"))
    divisor = F.col("n_events").cast("double") if raw else F.col("weight_sum")
    avg = F.coalesce(F.when(divisor > 0, F.abs("agg") / divisor), F.lit(0.0))
    sign = F.signum("agg").cast("int")
    return sums.select(
        direction(sign, "trade").alias("direction"),
        sign.alias("direction_sign"),
        F.round("agg", 4).alias("aggregated_signed_confidence"),
        F.round(avg, 4).alias("avg_confidence"),
        F.col("n_events").alias("n_contributors"),
        ((sign != 0) & (avg >= floor)).alias("actionable"),
    )


def _return_stats(ret: Column, prefix: str) -> list[Column]:
    return [
        F.avg(ret).alias(f"{prefix}mean"),
        F.stddev_samp(ret).alias(f"{prefix}std"),
        _count(ret > 0).alias(f"{prefix}hits"),
        F.product(1 + ret / 100.0).alias(f"{prefix}growth"),
    ]


def _sharpe(mean: str, std: str, periods: float = 252.0, least: float = 0.0) -> Column:
    return F.when(
        F.col(std) > least, F.round(F.col(mean) / F.col(std) * F.sqrt(F.lit(periods)), 4)
    )


def overlay_metrics(
    sessions: DataFrame, cost_bps_per_side: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Metrics of sessions before and after cost; drawdown is negative, unseeded."""
    by = list(by)
    cost = cost_bps_per_side * 2.0 / 100.0
    r = F.col("directional_return_pct")
    long, short = F.col("direction") > 0, F.col("direction") < 0
    session = F.col("session_return_pct")
    sums = sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        _count(F.col("hit")).alias("won"),
        _count(long).alias("long_trades"),
        _count(short).alias("short_trades"),
        F.avg(F.when(long, session)).alias("long_mean"),
        F.avg(F.when(short, session)).alias("short_mean"),
        *_return_stats(r, "r_"),
        *_return_stats(r - cost, "c_"),
    )
    dips = growth_summary(
        sessions,
        "directional_return_pct",
        [F.col("session_date")],
        [F.trunc("session_date", "month")],
        by,
        seeded=False,
    ).drop("growth")
    joined = sums.join(dips, by, "left") if by else _side_by_side(sums, dips)
    n = F.col("trades")
    return joined.select(
        *by,
        "trades",
        _ratio(F.col("won"), n).alias("hit_rate"),
        "long_trades",
        "short_trades",
        F.round("long_mean", 4).alias("mean_session_return_long_pct"),
        F.round("short_mean", 4).alias("mean_session_return_short_pct"),
        F.round("r_mean", 4).alias("directional_return_pct_mean"),
        F.round((F.col("r_growth") - 1.0) * 100.0, 4).alias("directional_return_pct_cum"),
        _sharpe("r_mean", "r_std").alias("sharpe_annualized"),
        F.round("worst_drawdown_pct", 4).alias("max_drawdown_pct"),
        F.round(F.lit(cost), 4).alias("round_trip_cost_pct"),
        _ratio(F.col("c_hits"), n).alias("after_cost_hit_rate"),
        F.round("c_mean", 4).alias("after_cost_mean_pct"),
        F.round((F.col("c_growth") - 1.0) * 100.0, 4).alias("after_cost_cum_pct"),
        _sharpe("c_mean", "c_std").alias("after_cost_sharpe"),
    )


def session_metrics(
    sessions: DataFrame, cost_bps: float = 5.0, by: Sequence[str] = ()
) -> DataFrame:
    """Second variant: drawdown on the after-cost curve from 1.0, Sharpe 0 if flat."""
    by = list(by)
    cost = 2.0 * cost_bps / 100.0
    after = sessions.withColumn("__after", F.col("directional_return_pct") - cost)
    r = F.col("directional_return_pct")
    sums = after.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        _count(F.col("hit")).alias("won"),
        *_return_stats(r, "r_"),
        F.product(1 + F.col("__after") / 100.0).alias("c_growth"),
    )
    dips = growth_summary(
        after, "__after", [F.col("session_date")], [F.trunc("session_date", "month")], by
    ).drop("growth")
    joined = sums.join(dips, by, "left") if by else _side_by_side(sums, dips)
    return joined.select(
        *by,
        "trades",
        _ratio(F.col("won"), F.col("trades")).alias("hit_rate"),
        F.round("r_mean", 4).alias("mean_directional_return_pct"),
        F.round((F.col("r_growth") - 1.0) * 100.0, 4).alias("cumulative_return_pct"),
        F.coalesce(_sharpe("r_mean", "r_std", least=1e-9), F.lit(0.0)).alias("sharpe_annualized"),
        F.round("worst_drawdown_pct", 4).alias("max_drawdown_pct"),
        F.round((F.col("c_growth") - 1.0) * 100.0, 4).alias("after_cost_cumulative_pct"),
    )


def by_confidence_bucket(sessions: DataFrame) -> DataFrame:
    """Hit rate and mean return per bucket; empty buckets stay as zero rows."""
    spark = sessions.sparkSession
    buckets = spark.createDataFrame(
        [(i, label) for i, (label, _) in enumerate(fx.CONFIDENCE_BUCKETS)], "ord int, bucket string"
    )
    stats = sessions.groupBy(F.col("confidence_bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        _count(F.col("hit")).alias("won"),
        F.avg("directional_return_pct").alias("mean"),
    )
    return buckets.join(stats, "bucket", "left").select(
        "ord",
        "bucket",
        F.coalesce("n", F.lit(0)).alias("trades"),
        _ratio(F.col("won"), F.col("n")).alias("hit_rate"),
        F.round("mean", 4).alias("directional_return_pct_mean"),
    )


def session_plan(df: DataFrame) -> DataFrame:
    """Stop and target of a session trade, widened to the prior day's extremes.

    Reads ``entry``, ``direction_sign``, ``atr_pct``, ``prior_day_high`` and
    ``prior_day_low``.
    """
    entry, side = F.col("entry"), F.col("direction_sign")
    pdh, pdl = F.col("prior_day_high"), F.col("prior_day_low")
    vol = F.when(F.col("atr_pct") > 0, F.col("atr_pct")).otherwise(F.lit(1.2))
    stop_pct = F.round(clamp(0.65 * vol, 0.35, 2.5), 4)
    target_pct = F.round(stop_pct * 2.0, 4)
    below, above = (pdl != 0) & (pdl < entry), (pdh != 0) & (pdh > entry)
    base = df.withColumns({"__stop_pct": stop_pct, "__target_pct": target_pct})
    long_stop = entry * (1.0 - F.col("__stop_pct") / 100.0)
    long_target = entry * (1.0 + F.col("__target_pct") / 100.0)
    short_stop = entry * (1.0 + F.col("__stop_pct") / 100.0)
    short_target = entry * (1.0 - F.col("__target_pct") / 100.0)
    stop = (
        F.when(side > 0, F.least(long_stop, F.when(below, pdl * 0.999)))
        .when(side < 0, F.greatest(short_stop, F.when(above, pdh * 1.001)))
        .otherwise(entry)
    )
    target = (
        F.when(side > 0, F.greatest(long_target, F.when(above, pdh)))
        .when(side < 0, F.least(short_target, F.when(below, pdl)))
        .otherwise(entry)
    )
    priced = base.withColumns({"__stop": stop, "__target": target})
    out = priced.withColumns(
        {
            "stop_price": F.round("__stop", 4),
            "target_price": F.round("__target", 4),
            "stop_pct": F.when(
                entry != 0, F.round(F.abs(entry - F.col("__stop")) / entry * 100.0, 4)
            ).otherwise(F.col("__stop_pct")),
            "target_pct": F.when(
                entry != 0, F.round(F.abs(F.col("__target") - entry) / entry * 100.0, 4)
            ).otherwise(F.col("__target_pct")),
        }
    )
    return out.withColumn(
        "risk_reward", F.when(F.col("stop_pct") > 0, F.round(F.col("target_pct") / F.col("stop_pct"), 2))
    ).drop("__stop", "__target", "__stop_pct", "__target_pct")
