"""Join sides whose size is checked before they are sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_side(df: DataFrame, most: int = 100_000, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is.

    For narrow rows of short values, such as dictionaries. Counting stops past
    ``most``; a larger side is joined by a shuffle. ``counted`` is counted
    instead where ``df`` gathers its rows into lists.
    """
    held = (df if counted is None else counted).limit(most + 1).count()
    return F.broadcast(df) if held <= most else df
