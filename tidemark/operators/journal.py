"""Trade journal statistics and trailing account state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def journal_stats(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status, win rate, profit and profit factor of closed trades."""
    closed = F.col("status") == "closed"
    pnl = F.coalesce(F.col("pnl_usd"), F.lit(0.0))
    win, loss = closed & (pnl > 0), closed & (pnl < 0)
    n_closed, n_win, n_loss = F.count_if(closed), F.count_if(win), F.count_if(loss)

    def total(test: Column) -> Column:
        return F.sum(F.when(test, pnl).otherwise(0.0))

    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades_total"),
        n_closed.alias("trades_closed"),
        F.count_if(F.col("status") == "open").alias("trades_open"),
        F.count_if(F.col("status") == "planned").alias("trades_planned"),
        F.when(n_closed > 0, F.round(n_win / n_closed, 4)).alias("win_rate"),
        F.round(total(closed), 2).alias("total_pnl_usd"),
        F.when(n_win > 0, F.round(total(win) / n_win, 2)).alias("avg_win_usd"),
        F.when(n_loss > 0, F.round(total(loss) / n_loss, 2)).alias("avg_loss_usd"),
        F.when(total(loss) != 0, F.round(total(win) / F.abs(total(loss)), 2)).alias(
            "profit_factor"
        ),
    )


def end_of_day_balances(trades: DataFrame, start: Column) -> DataFrame:
    """Balance of each account after each day of its closed trades.

    Summed per (account, day) first; the running sum is over days.
    """
    daily = (
        trades.where(F.col("status") == "closed")
        .groupBy("account", "day")
        .agg(F.sum(F.coalesce("pnl_usd", F.lit(0.0)).cast("decimal(18,2)")).alias("todays_pnl"))
    )
    upto = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn(
        "balance", start + F.sum("todays_pnl").over(upto).cast("double")
    ).withColumn("todays_pnl", F.col("todays_pnl").cast("double"))


def account_state(balances: DataFrame, presets: DataFrame, kill_buffer: float = 200.0) -> DataFrame:
    """Trailing floor, buffer and kill flag after each day.

    ``balances`` holds account, day, balance, todays_pnl and preset; ``presets``
    holds preset, start, trail, target. A ``peak`` column of ``balances`` gives the
    highest end-of-day balance known on a day; it trails the floor until it
    reaches the starting balance. Where it is missing or null, the peak is the
    highest balance so far and at least the starting balance, so the floor
    stands at the starting balance from the first day.
    """
    upto = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.col("start"), F.max("balance").over(upto))
    if "peak" in balances.columns:
        peak = F.coalesce(F.col("peak"), peak)
    rows = balances.join(presets, "preset").withColumn("peak", peak)
    locked = F.col("peak") >= F.col("start")
    floor = F.when(locked, F.col("start")).otherwise(F.col("peak") - F.col("trail"))
    buffer = F.col("balance") - F.col("floor")
    return rows.withColumn("floor", floor).select(
        "account",
        "day",
        "preset",
        F.round("balance", 2).alias("current_balance"),
        F.round("peak", 2).alias("peak_eod_balance"),
        F.round("todays_pnl", 2).alias("todays_pnl"),
        F.round("floor", 2).alias("trailing_floor"),
        F.round(buffer, 2).alias("buffer_remaining"),
        F.round(F.col("start") + F.col("target") - F.col("balance"), 2).alias("distance_to_target"),
        locked.alias("is_locked_floor"),
        (buffer < kill_buffer).alias("kill_switch_active"),
        F.when(buffer <= 0, F.lit("breached")).when(buffer < kill_buffer, F.lit("near")).alias(
            "kill_switch_reason"
        ),
    )
