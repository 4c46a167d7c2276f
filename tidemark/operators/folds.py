"""Time-ordered splits, walk-forward folds and per-fold selection.

Everything here works on positions in the order (T, symbol). No fold ever
copies its training rows: a training set is "all positions below its start".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core import ordinal, top_by
from tidemark.core.prefixes import prefix_thresholds
from tidemark.functions.signals import net_return

EVENT_ORDER = ("t_event", "symbol")


def event_order() -> list[Column]:
    return [F.col(c) for c in EVENT_ORDER]


def event_chunks() -> list[Column]:
    return [F.to_date("t_event")]


def with_position(df: DataFrame) -> DataFrame:
    """Add ``ord``, the position in time order."""
    return ordinal(df, event_order(), event_chunks(), name="ord")


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def time_split(df: DataFrame, ratio: float = fx.TRAIN_RATIO) -> DataFrame:
    """Add ``role``: the first ``ratio`` of events train, the others test."""
    n = row_count(df)
    cut = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(ratio))), n - 1)
    is_train = (n >= 2) & (F.col("ord") < cut)
    return with_position(df).withColumn(
        "role", F.when(is_train, F.lit("train")).otherwise(F.lit("test"))
    )


def partition_holdout(df: DataFrame, days: int = fx.HOLDOUT_DAYS) -> DataFrame:
    """Add ``holdout``: whether the event lies in the last ``days`` days."""
    if days <= 0:
        return df.withColumn("holdout", F.lit(False))
    cutoff = df.agg(F.max("t_event") - F.expr(f"INTERVAL {int(days)} DAYS")).scalar()
    return df.withColumn("holdout", F.col("t_event") > cutoff)


def walk_forward_folds(
    df: DataFrame, min_train: int = fx.MIN_TRAIN, chunk: int = fx.TEST_CHUNK
) -> DataFrame:
    """Add ``ord`` and the fold a row tests in; null before the first fold."""
    fold = F.floor((F.col("ord") - min_train) / chunk).cast("int")
    return with_position(df).withColumn("fold_id", F.when(F.col("ord") >= min_train, fold))


def fold_table(
    folded: DataFrame, min_train: int = fx.MIN_TRAIN, chunk: int = fx.TEST_CHUNK
) -> DataFrame:
    """One row per fold: sizes and time range of its test part."""
    return (
        folded.where(F.col("fold_id").isNotNull())
        .groupBy("fold_id")
        .agg(
            F.count(F.lit(1)).alias("test_events"),
            F.min("t_event").alias("test_start"),
            F.max("t_event").alias("test_end"),
        )
        .withColumn("train_events", (min_train + F.col("fold_id") * chunk).cast("bigint"))
    )


def best_first() -> list[Column]:
    return [F.col("confidence").desc(), *event_order()]


def top_k_signals(
    scored: DataFrame,
    by: list[str],
    k_long: Column | int = fx.TOP_K_LONG,
    k_short: Column | int = fx.TOP_K_SHORT,
) -> DataFrame:
    """The most confident longs and shorts of each group; ties go to the earliest."""
    k_long = k_long if isinstance(k_long, Column) else F.lit(k_long)
    k_short = k_short if isinstance(k_short, Column) else F.lit(k_short)
    k = F.when(F.col("signal") > 0, k_long).otherwise(k_short)
    return top_by(scored.where(F.col("signal") != 0), [*by, "signal"], best_first(), k)


def months_between(start: Column, end: Column) -> Column:
    """Whole days between two times as months of 30 days, at least 1."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.greatest(F.lit(1.0), F.floor(seconds / 86400) / 30.0)


def confidence_thresholds(
    folded: DataFrame,
    min_train: int = fx.MIN_TRAIN,
    chunk: int = fx.TEST_CHUNK,
    per_month: float = fx.TRADES_PER_MONTH,
    block_rows: int = 8192,
) -> DataFrame:
    """(``fold_id``, ``threshold``): the confidence that would have let ``per_month`` trades pass.

    It is the n-th largest confidence of the rows before the fold, n from the
    months those rows span. Training sets expand by one chunk per fold, so they
    are prefixes in time order, and one forward scan over chunks serves all
    folds; no fold copies its rows. ``folded`` holds ``ord``, ``t_event`` and
    ``confidence``. The driver sees the number of rows, the first time, and the
    largest n, which the calendar bounds.
    """
    start, end, rows = folded.agg(
        F.min("t_event"), F.max("t_event"), F.count(F.lit(1))
    ).first()
    chunks = 1 + (rows - min_train - 1) // chunk if rows > min_train else 0
    if not chunks:
        return folded.sparkSession.createDataFrame([], "fold_id int, threshold double")

    def wanted(last: Column) -> Column:
        months = months_between(F.lit(start), last)
        return F.greatest(F.lit(1), F.bround(per_month * months).cast("int"))

    most = folded.sparkSession.range(1).select(wanted(F.lit(end)).alias("n")).first()["n"]
    number = F.when(F.col("ord") < min_train, 0).otherwise(
        1 + F.floor((F.col("ord") - min_train) / chunk)
    )
    upto = F.col("ord") + 1
    ends = (upto >= min_train) & ((upto - min_train) % chunk == 0)
    scanned = prefix_thresholds(
        folded.where(F.col("ord") < min_train + (chunks - 1) * chunk).select(
            number.cast("long").alias("chunk"),
            F.col("confidence").cast("double").alias("value"),
            F.when(ends, F.least(wanted(F.col("t_event")), upto)).cast("int").alias("n"),
        ),
        chunks,
        most,
        max(1, block_rows // chunk),
    )
    return scanned.select(F.col("chunk").cast("int").alias("fold_id"), "threshold")


def overall_threshold(train: DataFrame, per_month: float = fx.TRADES_PER_MONTH) -> Column:
    """The threshold of one training set, as a scalar."""
    wanted = F.bround(per_month * months_between(F.min("t_event"), F.max("t_event"))).cast("int")
    k = train.agg(F.least(F.greatest(F.lit(1), wanted), F.count(F.lit(1))).cast("int")).scalar()
    ranked = top_by(train, [], best_first(), k)
    return ranked.agg(F.max(F.when(F.col("rank") == k, F.col("confidence")))).scalar()


def as_trades(picked: DataFrame, cost_bps: float = fx.ROUND_TRIP_COST_BPS) -> DataFrame:
    """Selected signals as equal-weight trades."""
    net = net_return(F.col("signal"), F.col("actual_5d_return_pct"), cost_bps)
    return picked.withColumns(
        {
            "taken": F.lit(True),
            "net_return_pct": F.round(net, 4),
            "position_weight": F.lit(1.0),
            "won": net > 0,
        }
    )


def top_k_lane(
    scored: DataFrame, k_long: int = fx.TOP_K_LONG, k_short: int = fx.TOP_K_SHORT,
    cost_bps: float = fx.ROUND_TRIP_COST_BPS,
) -> DataFrame:
    """Test rows of all folds, with the per-fold top-k taken as trades."""
    picked = top_k_signals(scored, ["fold_id"], k_long, k_short).select(
        "symbol", "t_event", F.lit(True).alias("picked")
    )
    rows = as_trades(scored, cost_bps).drop("taken")
    return (
        rows.join(picked, ["symbol", "t_event"], "left")
        .withColumn("taken", F.coalesce("picked", F.lit(False)))
        .drop("picked")
    )


def threshold_lane(
    scored: DataFrame, thresholds: DataFrame, cost_bps: float = fx.ROUND_TRIP_COST_BPS
) -> DataFrame:
    """Test rows of all folds, taken where they reach their fold's threshold."""
    return (
        as_trades(scored, cost_bps)
        .drop("taken")
        .join(thresholds, "fold_id")
        .withColumn("taken", F.col("confidence") >= F.col("threshold"))
    )


def holdout_lanes(
    working: DataFrame,
    holdout: DataFrame,
    k_long: int = fx.TOP_K_LONG,
    k_short: int = fx.TOP_K_SHORT,
    per_month: float = fx.TRADES_PER_MONTH,
    cost_bps: float = fx.ROUND_TRIP_COST_BPS,
) -> DataFrame:
    """Holdout rows per lane ("top_k", "threshold"); K grows with the holdout's length."""
    span = holdout.agg(
        F.greatest(
            F.lit(1.0),
            F.floor(
                (
                    F.unix_timestamp(F.max("t_event").cast("timestamp"))
                    - F.unix_timestamp(F.min("t_event").cast("timestamp"))
                )
                / 86400
            ),
        )
        / 30.0
    ).scalar()

    def scaled(k: int) -> Column:
        return F.greatest(F.lit(1), F.bround(span * k).cast("int"))

    one = F.lit(0).alias("fold_id")
    rows = holdout.select("*", one)
    picked = top_k_signals(rows, ["fold_id"], scaled(k_long), scaled(k_short)).select(
        "symbol", "t_event", F.lit(True).alias("picked")
    )
    trades = as_trades(rows, cost_bps).drop("taken")
    by_rank = (
        trades.join(picked, ["symbol", "t_event"], "left")
        .withColumn("taken", F.coalesce("picked", F.lit(False)))
        .withColumn("lane", F.lit("top_k"))
        .drop("picked")
    )
    by_level = trades.withColumns(
        {
            "taken": F.col("confidence") >= overall_threshold(working, per_month),
            "lane": F.lit("threshold"),
        }
    )
    return by_rank.unionByName(by_level)
