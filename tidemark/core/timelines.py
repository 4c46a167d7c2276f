"""Running totals of changes at arbitrary instants, without pairing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def total_at(
    probes: DataFrame,
    changes: DataFrame,
    by: Sequence[str],
    ts: str,
    name: str = "total",
) -> DataFrame:
    """Sum of changes in force at each distinct (``by``, ``ts``, ``rank``) of ``probes``.

    ``changes`` holds ``change`` and ``rank``; at one instant, rows take effect
    in the order of ``rank``, and a probe sees what ranks below it. Changes are
    summed per instant first; a window orders the instants of one day, a second
    one the days, so no group is ordered as a whole.
    """
    by = list(by)
    keys = by + ["__day"]
    instants = changes.groupBy(*by, ts, "rank").agg(F.sum("change").alias("__delta"))
    asked = (
        probes.select(*by, ts, "rank").distinct().withColumn("__delta", F.lit(None).cast("bigint"))
    )
    line = instants.unionByName(asked).withColumn("__day", F.to_date(ts))
    in_day = (
        Window.partitionBy(*keys).orderBy(ts, "rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    days_before = (
        Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    )
    days = (
        line.groupBy(*keys)
        .agg(F.coalesce(F.sum("__delta"), F.lit(0)).alias("__sum"))
        .withColumn("__carry", F.coalesce(F.sum("__sum").over(days_before), F.lit(0)))
    )
    inside = F.coalesce(F.sum("__delta").over(in_day), F.lit(0))
    return (
        line.withColumn("__inside", inside)
        .where(F.col("__delta").isNull())
        .join(days.select(*keys, "__carry"), keys)
        .select(*by, ts, "rank", (F.col("__inside") + F.col("__carry")).alias(name))
    )
