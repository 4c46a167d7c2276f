"""Signal, label and return expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx

# Labels for (positive, negative, neutral) signs.
DIRECTIONS = {
    "market": ("bullish", "bearish", "mixed"),
    "move": ("up", "down", "flat"),
    "trade": ("long", "short", "flat"),
}


def pct_change(start: Column, end: Column) -> Column:
    """Percent change; null where the start is 0 or either side is missing."""
    return F.when(start != 0, (end - start) / start * 100.0)


def sign_dz(value: Column, dead_zone: float) -> Column:
    """+1 / -1 outside the dead zone, 0 on or inside it."""
    return (
        F.when(value > dead_zone, F.lit(1))
        .when(value < -dead_zone, F.lit(-1))
        .when(value.isNotNull(), F.lit(0))
    )


def direction(sign: Column, style: str = "market") -> Column:
    up, down, flat = DIRECTIONS[style]
    return F.when(sign > 0, F.lit(up)).when(sign < 0, F.lit(down)).otherwise(F.lit(flat))


def num0(value: Column) -> Column:
    """Number, or 0.0 where the value is missing or is no number."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def num0_columns(df: DataFrame, names) -> DataFrame:
    """Named columns as numbers; a column the frame lacks becomes 0.0."""
    return df.withColumns(
        {n: num0(F.col(n)) if n in df.columns else F.lit(0.0) for n in names}
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def confidence_bucket(confidence: Column) -> Column:
    out = None
    for label, upper in fx.CONFIDENCE_BUCKETS:
        if upper is None:
            return out.otherwise(F.lit(label))
        test = confidence < upper
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def position_weight(
    confidence: Column,
    low: float = fx.MIN_POSITION_WEIGHT,
    high: float = fx.MAX_POSITION_WEIGHT,
) -> Column:
    return F.round(clamp(low + clamp(confidence, 0.0, 1.0) * (high - low), low, high), 4)


def gross_return(signal: Column, ret: Column) -> Column:
    return signal * ret


def net_return(signal: Column, ret: Column, cost_bps: float = fx.ROUND_TRIP_COST_BPS) -> Column:
    return gross_return(signal, ret) - cost_bps / 100.0


def signal_confidence(confidence: Column, pre_return: Column) -> Column:
    """Given confidence if positive, else one grown from the prior move."""
    given = F.coalesce(confidence, F.lit(0.0))
    grown = F.least(F.lit(1.0), 0.15 + F.abs(F.coalesce(pre_return, F.lit(0.0))) / 12.0)
    return F.when(given > 0, given).otherwise(grown)


def heuristic_signal(
    pre_return: Column,
    mentions: Column,
    relevance: Column,
    spill_mentions: Column,
    dead_zone: float = fx.SIGNAL_DEAD_ZONE,
) -> tuple[Column, Column]:
    """Momentum sign, with a confidence that grows with corroborating news."""
    confidence = F.least(
        F.lit(1.0),
        0.20
        + 0.05 * F.coalesce(mentions, F.lit(0))
        + 0.05 * F.coalesce(relevance, F.lit(0.0))
        + 0.02 * F.coalesce(spill_mentions, F.lit(0))
        + F.abs(pre_return) / 20.0,
    )
    return sign_dz(pre_return, dead_zone), F.round(confidence, 4)


def event_key(symbol: Column, t_event: Column) -> tuple[Column, Column]:
    """Joinable key of an event: upper-case symbol and whole-second time."""
    return F.upper(F.trim(symbol)), F.date_trunc("second", t_event)
