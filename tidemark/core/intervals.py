"""Joins and aggregates of facts in a closed look-back window before an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _start(event_ts: str, days: int) -> Column:
    return F.col(event_ts) - F.expr(f"INTERVAL {int(days)} DAYS")


def interval_join(
    events: DataFrame,
    facts: DataFrame,
    event_ts: str = "t_event",
    fact_ts: str = "published_at",
    days: int = 7,
    by: Sequence[str] = (),
) -> DataFrame:
    """All (event, fact) pairs with the fact in the closed ``[T - days, T]``.

    Each event is spread over the calendar days it looks back on and meets the
    facts in an equi-join on the day, instead of a nested-loop range join. The
    exact bounds are checked on the joined rows.
    """
    by = list(by)
    spread = events.withColumn(
        "__day",
        F.explode(F.sequence(F.to_date(_start(event_ts, days)), F.to_date(F.col(event_ts)))),
    )
    dated = facts.where(F.col(fact_ts).isNotNull()).withColumn("__day", F.to_date(F.col(fact_ts)))
    return (
        spread.join(dated, by + ["__day"])
        .where(F.col(fact_ts).between(_start(event_ts, days), F.col(event_ts)))
        .drop("__day")
    )


def interval_rollup(
    probes: DataFrame,
    facts: DataFrame,
    by: Sequence[str],
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    event_ts: str = "t_event",
    fact_ts: str = "published_at",
    days: int = 7,
) -> DataFrame:
    """Sums and maxima of facts in ``[T - days, T]`` per distinct (``by``, T).

    Whole days inside the window are read from one pre-aggregated row per
    (``by``, day). Only the cut days at the two ends touch single facts. A group
    that owns a third of all facts is therefore reduced map-side before any
    shuffle, and no event is paired with every fact of its week.
    """
    by = list(by)
    merge = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    measures = [*sums, *maxima]
    probes = probes.select(*by, event_ts).distinct()
    dated = facts.where(F.col(fact_ts).isNotNull()).select(
        *by, fact_ts, F.to_date(F.col(fact_ts)).alias("__day"), *measures
    )
    start = _start(event_ts, days)
    starts_whole = start == F.date_trunc("day", start)
    first_whole = F.when(starts_whole, F.to_date(start)).otherwise(F.date_add(F.to_date(start), 1))
    last_whole = F.date_sub(F.to_date(F.col(event_ts)), 1)

    daily = dated.groupBy(*by, "__day").agg(*merge)
    whole = (
        probes.where(first_whole <= last_whole)
        .withColumn("__day", F.explode(F.sequence(first_whole, last_whole)))
        .join(daily, by + ["__day"])
        .select(*by, event_ts, *measures)
    )
    # One row per distinct instant is enough for the cut days.
    instants = dated.groupBy(*by, "__day", fact_ts).agg(*merge)
    end_days = F.when(starts_whole, F.array(F.to_date(F.col(event_ts)))).otherwise(
        F.array_distinct(F.array(F.to_date(start), F.to_date(F.col(event_ts))))
    )
    cut = (
        probes.withColumn("__day", F.explode(end_days))
        .join(instants, by + ["__day"])
        .where(F.col(fact_ts).between(start, F.col(event_ts)))
        .select(*by, event_ts, *measures)
    )
    return whole.unionByName(cut).groupBy(*by, event_ts).agg(*merge)
