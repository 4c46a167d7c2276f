"""As-of joins between event times and daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    events: DataFrame,
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    event_ts: str = "t_event",
    bar_date: str = "d",
    direction: str = "forward",
    strict: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Attach to each event the nearest bar of its group on or after its date.

    ``direction="backward"`` takes the nearest bar on or before it, ``strict``
    leaves out a bar on the date itself. All bar columns are attached, so
    offsets ("5 bars later") are lag/lead columns of ``bars`` computed once.

    The search runs over the distinct (group, date) pairs of the events, which
    the calendar bounds however many events share a date. The events then meet
    their answer in an equi-join on (group, date).
    """
    by = list(by)
    forward = direction == "forward"
    probe_date = F.to_date(F.col(event_ts))
    payload = [c for c in bars.columns if c not in by]
    dated = events.withColumn("__on", probe_date)
    bar_rows = bars.select(
        *by, F.col(bar_date).alias("__on"), F.struct(*payload).alias("__bar")
    )
    probes = dated.select(*by, "__on").distinct()
    both = bar_rows.withColumn("__probe", F.lit(0)).unionByName(
        probes.withColumn("__probe", F.lit(1)), allowMissingColumns=True
    )
    near = F.col("__on").asc() if not forward else F.col("__on").desc()
    tie = F.col("__probe").desc() if strict else F.col("__probe").asc()
    seen = (
        Window.partitionBy(*by).orderBy(near, tie).rowsBetween(Window.unboundedPreceding, 0)
    )
    answers = (
        both.withColumn("__hit", F.last("__bar", ignorenulls=True).over(seen))
        .where((F.col("__probe") == 1) & F.col("__hit").isNotNull())
        .select(*by, "__on", "__hit")
    )
    joined = dated.join(answers, by + ["__on"], how)
    return joined.select(
        *[c for c in events.columns], *[F.col(f"__hit.{c}").alias(c) for c in payload]
    )
