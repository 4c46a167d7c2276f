"""Trade levels, barrier outcomes, signals to trades, and strategy metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core import asof_join, exact_median
from tidemark.core.ordering import growth_summary, running_growth
from tidemark.functions.signals import clamp, direction, net_return, position_weight, signal_confidence

DEFAULT_SECTOR = "AI Compute"


def swing_levels_plan(df: DataFrame, hedges: DataFrame, company: DataFrame) -> DataFrame:
    """Stop and target of a trade from ``entry``, ``signal``, ``predicted_move``, ``vol``.

    ``hedges`` holds the first hedge of each sector; only shorts get one.
    """
    move = F.abs("predicted_move")
    vol = F.when(F.col("vol") > 0, F.col("vol")).otherwise(clamp(move / 3.0, 1.0, 4.0))
    traded = (F.col("entry") > 0) & (F.col("signal") != 0)
    long = F.col("signal") > 0
    side = F.when(long, F.lit(1.0)).otherwise(F.lit(-1.0))
    with_pct = df.withColumn(
        "stop_pct", F.when(traded, F.round(clamp(0.45 * move + 0.65 * vol, 1.0, 8.0), 4))
    ).withColumn(
        "target_pct",
        F.when(traded, F.round(F.greatest(F.col("stop_pct") * 1.5, 0.55 * move), 4)),
    )
    levels = with_pct.withColumns(
        {
            "entry_price": F.when(traded, F.round("entry", 4)),
            "stop_price": F.round(F.col("entry") * (1.0 - side * F.col("stop_pct") / 100.0), 4),
            "target_price": F.round(F.col("entry") * (1.0 + side * F.col("target_pct") / 100.0), 4),
            "trade_direction": F.when(traded, direction(F.col("signal"), "trade")),
            "leverage_or_hedge": F.when(
                traded, F.when(long, F.lit("Leverage")).otherwise(F.lit("Hedge"))
            ),
        }
    )
    hedged = company.select("symbol", "sector").join(hedges, "sector", "left").select(
        "symbol", "hedge"
    )
    fallback = hedges.where(F.col("sector") == DEFAULT_SECTOR).agg(F.first("hedge")).scalar()
    known = hedged.withColumn("known", F.lit(True))
    return (
        levels.join(known, "symbol", "left")
        .withColumn(
            "suggested_hedge",
            F.when(
                F.col("signal") < 0,
                F.when(F.col("known"), F.col("hedge")).otherwise(fallback),
            ),
        )
        .drop("known", "hedge")
    )


def bars_ahead(bars: DataFrame, n: int = 5) -> DataFrame:
    """Each bar with its trailing volatility and the next ``n`` bars as an array."""
    by_date = Window.partitionBy("symbol").orderBy("d")
    prev = F.lag("close").over(by_date)
    with_ret = bars.withColumns(
        {
            "ret": F.when(prev != 0, (F.col("close") - prev) / prev),
            "idx": F.row_number().over(by_date) - 1,
        }
    )
    vol = F.stddev_samp("ret").over(by_date.rowsBetween(-58, 0)) * 100.0
    return with_ret.select(
        "symbol",
        "d",
        F.col("close").alias("entry"),
        F.round(F.when(F.col("idx") >= 4, vol).otherwise(F.lit(2.0)), 4).alias("vol"),
        F.collect_list(F.struct("high", "low", "close"))
        .over(by_date.rowsBetween(1, n))
        .alias("ahead"),
    )


def first_touch(df: DataFrame, max_days: int = 5) -> DataFrame:
    """Outcome of entering at ``entry``: the first of stop, target or last close.

    Reads ``signal``, ``entry``, ``stop_price``, ``target_price`` and ``ahead``.
    A bar that touches both counts as stopped.
    """
    long = F.col("signal") > 0
    side = F.when(long, F.lit(1.0)).otherwise(F.lit(-1.0))
    bars = F.slice("ahead", 1, max_days)

    def touched(bar: Column, day: Column) -> Column:
        stop = F.when(long, bar["low"] <= F.col("stop_price")).otherwise(
            bar["high"] >= F.col("stop_price")
        )
        target = F.when(long, bar["high"] >= F.col("target_price")).otherwise(
            bar["low"] <= F.col("target_price")
        )
        return F.struct((day + 1).alias("day"), stop.alias("stop"), target.alias("target"))

    hits = F.filter(F.transform(bars, touched), lambda h: h["stop"] | h["target"])
    base = df.withColumns({"__hit": F.get(hits, F.lit(0)), "__n": F.size(bars)})
    last = F.get(F.col("ahead"), F.col("__n") - 1)["close"]
    playable = (F.col("signal") != 0) & (F.col("entry") > 0) & (F.col("__n") > 0)
    reason = (
        F.when(~playable, F.lit("no_data"))
        .when(F.col("__hit").isNull(), F.lit("time"))
        .when(F.col("__hit.stop"), F.lit("stop"))
        .otherwise(F.lit("target"))
    )
    named = base.withColumn("path_exit_reason", reason)
    stopped = F.col("path_exit_reason") == "stop"
    on_target = F.col("path_exit_reason") == "target"
    exit_price = (
        F.when(stopped, F.col("stop_price"))
        .when(on_target, F.col("target_price"))
        .when(F.col("path_exit_reason") == "time", F.round(last, 4))
    )
    raw_exit = F.when(F.col("path_exit_reason") == "time", last).otherwise(F.col("path_exit_price"))
    out = named.withColumns(
        {
            "path_exit_price": exit_price,
            "path_stop_hit": stopped,
            "path_target_hit": on_target,
            "path_holding_days": F.when(
                playable, F.coalesce(F.col("__hit.day"), F.col("__n"))
            ).otherwise(F.lit(0)),
        }
    )
    ret = F.when(playable, side * (raw_exit - F.col("entry")) / F.col("entry") * 100.0)
    return (
        out.withColumn("__ret", ret)
        .withColumns(
            {
                "path_return_pct": F.round("__ret", 4),
                "path_won": F.coalesce(F.col("__ret") > 0, F.lit(False)),
                "direction_correct": F.coalesce(F.round("__ret", 4) > 0, F.lit(False)),
            }
        )
        .drop("__hit", "__n", "__ret", "ahead")
    )


def trade_paths(
    events: DataFrame,
    bars: DataFrame,
    hedges: DataFrame,
    company: DataFrame,
    signal: str = "enhanced_pred_sign",
    fallback: str = "baseline_pred_sign",
    max_days: int = 5,
) -> DataFrame:
    """Levels and barrier outcome of each event with a signal.

    Volatility is the trailing one at the event's bar.
    """
    sign = F.coalesce(F.nullif(F.col(signal), F.lit(0)), F.col(fallback), F.lit(0))
    placed = asof_join(
        events.withColumn("signal", sign).where(F.col("signal") != 0),
        bars_ahead(bars, max_days),
    ).where(F.col("entry") > 0)
    planned = swing_levels_plan(
        placed.withColumn("predicted_move", F.col("baseline_pre_7d_return_pct")), hedges, company
    )
    return first_touch(planned, max_days).drop("d", "vol", "predicted_move")


def simulate_signal(
    events: DataFrame,
    signal: str,
    confidence: str,
    cost_bps: float = fx.ROUND_TRIP_COST_BPS,
    min_confidence: float = fx.MIN_CONFIDENCE,
    weight: Column | None = None,
    ret: str = "actual_5d_return_pct",
) -> DataFrame:
    """Every event as a trade or a skipped row (``taken`` tells which)."""
    side = F.signum(F.coalesce(F.col(signal), F.lit(0))).cast("int")
    conf = F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))
    actual = F.col(ret)
    return events.withColumns(
        {
            "signal": side,
            "confidence": F.round(conf, 4),
            "taken": (side != 0) & (conf >= min_confidence),
            "gross_return_pct": F.round(side * actual, 4),
            "net_return_pct": F.round(net_return(side, actual, cost_bps), 4),
            "won": net_return(side, actual, cost_bps) > 0,
            "position_weight": position_weight(conf) if weight is None else weight,
        }
    )


def path_trades(
    events: DataFrame,
    signal: str = "enhanced_pred_sign",
    confidence: str = "enhanced_confidence",
    cost_bps: float = fx.ROUND_TRIP_COST_BPS,
    min_confidence: float = fx.MIN_CONFIDENCE,
) -> DataFrame:
    """Trades that exit as their barrier outcome says; no outcome, no trade."""
    side = F.signum(F.coalesce(F.col(signal), F.lit(0))).cast("int")
    conf = signal_confidence(F.col(confidence), F.col("baseline_pre_7d_return_pct"))
    net = F.col("path_return_pct") - cost_bps / 100.0
    return events.withColumns(
        {
            "signal": side,
            "confidence": F.round(conf, 4),
            "taken": (side != 0)
            & (conf >= min_confidence)
            & F.col("path_return_pct").isNotNull(),
            "net_return_pct": F.round(net, 4),
            "won": net > 0,
            "position_weight": position_weight(conf),
        }
    )


def _ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b != 0, F.round(a / b, digits))


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def strategy_metrics(
    trades: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    chunks: Sequence[Column],
    periods: float = 50.0,
    path: bool = False,
) -> DataFrame:
    """Metrics per strategy of the taken rows; skipped rows are counted.

    Sums reduce map-side. The drawdown and the median use the chunked forms, so
    a strategy that owns a third of all trades never meets in one task.
    """
    by = list(by)
    weighted = trades.withColumn(
        "__r", F.when(F.col("taken"), F.col("net_return_pct") * F.col("position_weight"))
    )
    r = F.col("__r")
    aggs = [
        F.count(r).alias("trades"),
        _count(~F.col("taken")).alias("skipped"),
        _count(r > 0).alias("total_wins"),
        _count(r <= 0).alias("total_losses"),
        F.avg(r).alias("__mean"),
        F.stddev_samp(r).alias("__std"),
    ]
    if path:
        aggs += [
            _count(F.col("taken") & F.col("path_stop_hit")).alias("__stops"),
            _count(F.col("taken") & F.col("path_target_hit")).alias("__targets"),
        ]
    sums = weighted.groupBy(*by).agg(*aggs)
    taken = weighted.where(F.col("taken"))
    middle = exact_median(taken, "__r", by, name="__median")
    growth = growth_summary(taken, "__r", order, chunks, by, seeded=True)
    joined = sums.join(middle, by, "left").join(growth, by, "left") if by else _side_by_side(
        sums, middle, growth
    )
    return metric_columns(joined, by, periods, path)


def metric_columns(
    joined: DataFrame, by: Sequence[str], periods: float = 50.0, path: bool = False
) -> DataFrame:
    """The metrics of ``strategy_metrics`` from counts, moments, median, growth and drawdown."""
    out = {
        "trades": F.col("trades"),
        "skipped": F.col("skipped"),
        "hit_rate": _ratio(F.col("total_wins"), F.col("trades")),
        "mean_trade_return_pct": F.round("__mean", 4),
        "median_trade_return_pct": F.round("__median", 4),
        "cumulative_return_pct": F.round((F.col("growth") - 1.0) * 100.0, 4),
        "max_drawdown_pct": F.round(-F.col("worst_drawdown_pct"), 4),
        "sharpe_ratio": F.when(
            F.col("__std") > 0, F.round(F.col("__mean") / F.col("__std") * F.sqrt(F.lit(periods)), 4)
        ),
        "total_wins": F.col("total_wins"),
        "total_losses": F.col("total_losses"),
    }
    if path:
        out["stop_hit_rate"] = _ratio(F.col("__stops"), F.col("trades"))
        out["target_hit_rate"] = _ratio(F.col("__targets"), F.col("trades"))
    return joined.select(*by, *[c.alias(name) for name, c in out.items()])


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """Join one-row frames."""
    out = None
    for frame in frames:
        keyed = frame.withColumn("__one", F.lit(1))
        out = keyed if out is None else out.join(keyed, "__one", "left")
    return out.drop("__one")


def equity_curve(
    trades: DataFrame,
    ret: str,
    order: Sequence[Column],
    chunks: Sequence[Column],
    by: Sequence[str] = (),
    seeded: bool = True,
) -> DataFrame:
    """Compounded level and drawdown after each row."""
    return running_growth(trades, ret, order, chunks, by, seeded)


def best_by(df: DataFrame, value: str, order: str, largest: bool = True) -> DataFrame:
    """The single best row; the first in ``order`` wins a tie."""
    others = F.struct(*[F.col(c) for c in df.columns])
    worth = F.col(value) if largest else -F.col(value)
    picked = df.where(F.col(value).isNotNull()).agg(
        F.max_by(others, F.struct(worth, -F.col(order))).alias("best")
    )
    return picked.select("best.*")
