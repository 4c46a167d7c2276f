"""Accuracy, coverage and quality summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fx


def _scored(pred: str) -> Column:
    return (F.col(pred) != 0) & (F.col("actual_sign") != 0)


def _ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b > 0, F.round(a / b, digits))


def sign_accuracy(events: DataFrame, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Events, events with both signs set, correct ones, and their share."""
    right = _scored(pred) & (F.col(pred) == F.col("actual_sign"))
    return (
        events.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(_scored(pred)).alias("scored"),
            F.count_if(right).alias("correct"),
        )
        .withColumn("accuracy", _ratio(F.col("correct"), F.col("scored")))
    )


def uplift(
    events: DataFrame,
    baseline: str = "baseline_pred_sign",
    enhanced: str = "enhanced_pred_sign",
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy of two signals in one pass, and their gap in percentage points."""

    def sums(pred: str, name: str) -> list[Column]:
        right = _scored(pred) & (F.col(pred) == F.col("actual_sign"))
        return [
            F.count_if(_scored(pred)).alias(f"{name}_total"),
            F.count_if(right).alias(f"{name}_correct"),
        ]

    agg = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events_in_subset"),
        *sums(baseline, "baseline"),
        *sums(enhanced, "enhanced"),
    )
    base = F.when(F.col("baseline_total") > 0, F.col("baseline_correct") / F.col("baseline_total"))
    enh = F.when(F.col("enhanced_total") > 0, F.col("enhanced_correct") / F.col("enhanced_total"))
    return agg.withColumns(
        {
            "baseline_accuracy": F.round(base, 4),
            "enhanced_accuracy": F.round(enh, 4),
            "uplift_pp": F.round((enh - base) * 100.0, 2),
        }
    )


def coverage_summary(events: DataFrame) -> DataFrame:
    """How many events have news, encoder scores and spillover mentions."""
    n = F.count(F.lit(1))
    news = F.count_if(F.col("sent_doc_count") > 0)
    considered = F.count_if(F.col("enhanced_documents_considered") > 0)
    spill_there = (F.col("enhanced_documents_considered") > 0) & (F.col("spillover_mentions_7d") > 0)
    encoded = F.count_if(F.col("sent_enc_doc_count") > 0)
    return events.agg(
        n.alias("events_total"),
        news.alias("events_with_any_news"),
        encoded.alias("events_with_encoder_score"),
        F.count_if(F.col("spillover_mentions_7d") > 0).alias("events_with_spillover"),
        _ratio(n - news, n).alias("zero_news_event_pct"),
        _ratio(considered, n).alias("enhanced_feature_coverage"),
        _ratio(F.count_if(spill_there), considered).alias("spillover_coverage_within_enhanced"),
        _ratio(encoded, n).alias("encoder_feature_coverage"),
    )


def low_coverage_symbols(
    events: DataFrame, least_events: int = 4, below: float = 0.25, n: int = 25
) -> DataFrame:
    """Symbols whose events mostly lack news, worst first."""
    share = F.col("events_with_news") / F.col("events")
    return (
        events.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("sent_doc_count") > 0).alias("events_with_news"),
        )
        .where((F.col("events") >= least_events) & (share < below))
        .withColumn("coverage_pct", F.round(share, 4))
        .orderBy("coverage_pct", F.col("events").desc(), "symbol")
        .limit(n)
    )


def path_summary(events: DataFrame) -> DataFrame:
    """Win, stop, target and direction rates of events with a path outcome."""
    done = events.where(F.col("path_return_pct").isNotNull())

    def rate(name: str) -> Column:
        return F.round(F.avg(F.col(name).cast("int")), 4)

    return done.agg(
        F.count(F.lit(1)).alias("events_with_path"),
        rate("path_won").alias("path_win_rate"),
        rate("path_stop_hit").alias("stop_hit_rate"),
        rate("path_target_hit").alias("target_hit_rate"),
        rate("direction_correct").alias("direction_accuracy_with_stops"),
        F.round(F.avg("path_return_pct"), 4).alias("mean_path_return_pct"),
    )


def classification_metrics(
    pred: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 where undefined."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    agg = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(y == p).alias("right"),
        F.count_if(y & p).alias("tp"),
        F.count_if(p).alias("said"),
        F.count_if(y).alias("true"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return agg.select(
        *by,
        "n_test",
        F.round(share(F.col("right"), F.col("n_test")), 6).alias("accuracy"),
        F.round(share(F.col("tp"), F.col("said")), 6).alias("precision"),
        F.round(share(F.col("tp"), F.col("true")), 6).alias("recall"),
        F.round(share(2.0 * F.col("tp"), F.col("said") + F.col("true")), 6).alias("f1"),
    )


def fold_mean_accuracy(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean accuracy of the folds that tested anything."""
    return (
        folds.where(F.col("n_test") > 0)
        .groupBy(*by)
        .agg(F.round(F.avg("accuracy"), 4).alias("fold_mean_accuracy"), F.count(F.lit(1)).alias("folds"))
    )


def data_quality(events: DataFrame, least: int = fx.MIN_TRAIN + fx.TEST_CHUNK) -> DataFrame:
    """Counts and warnings about thin or uncovered event sets."""
    n = F.col("events_labeled")
    zero_share = F.when(n > 0, F.col("zero_news") / n)
    coverage = F.when(n > 0, F.col("with_documents") / n)
    encoded = F.when(n > 0, F.col("encoded") / n)
    warnings = F.array_compact(
        F.array(
            F.when(n < least, F.lit("few_events")),
            F.when(zero_share > 0.5, F.lit("zero_news")),
            F.when(coverage < 0.25, F.lit("sparse_features")),
            F.when((F.col("encoded") > 0) & (encoded < 0.10), F.lit("sparse_encoder")),
        )
    )
    return (
        events.agg(
            F.count(F.lit(1)).alias("events_labeled"),
            F.countDistinct("symbol").alias("symbols"),
            F.count_if(F.col("sent_doc_count") == 0).alias("zero_news"),
            F.count_if(F.col("enhanced_documents_considered") > 0).alias("with_documents"),
            F.count_if(F.col("sent_enc_doc_count") > 0).alias("encoded"),
        )
        .withColumns(
            {
                "zero_news_event_pct": F.round(zero_share, 4),
                "enhanced_feature_coverage": F.round(coverage, 4),
                "encoder_feature_coverage": F.round(encoded, 4),
                "warnings": warnings,
            }
        )
        .drop("zero_news", "with_documents", "encoded")
    )


def rescore_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sign flips and confidence changes between two scorings of the same events."""
    on = ["symbol", "t_event"]
    before = old.select(
        *on,
        F.coalesce("enhanced_pred_sign", F.lit(0)).alias("old_sign"),
        F.coalesce("enhanced_confidence", F.lit(0.0)).alias("old_conf"),
    )
    after = new.select(
        *on,
        F.coalesce("enhanced_pred_sign", F.lit(0)).alias("new_sign"),
        F.coalesce("enhanced_confidence", F.lit(0.0)).alias("new_conf"),
    )
    change = F.col("new_conf") - F.col("old_conf")
    return before.join(after, on).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("old_sign") != F.col("new_sign")).alias("sign_flips_vs_prior"),
        F.round(F.avg(change), 6).alias("mean_confidence_delta"),
        F.round(F.avg(F.abs(change)), 6).alias("mean_abs_confidence_delta"),
    )


DASHBOARD_METRICS = (
    "trades",
    "hit_rate",
    "cumulative_return_pct",
    "sharpe_ratio",
    "max_drawdown_pct",
    "mean_trade_return_pct",
)


def dashboard_strategies(metrics: DataFrame) -> DataFrame:
    return metrics.select("strategy", *DASHBOARD_METRICS)


def dashboard_events(events: DataFrame, n: int = 8) -> DataFrame:
    """Preview of the first events in time order, at most 30."""
    return events.orderBy("t_event", "symbol").limit(max(1, min(n, 30)))


def feature_importance(importances: DataFrame, family: str = "earnings_kw_") -> DataFrame:
    """Gain share and rank per feature from (feature, gain); unused ones marked.

    One row per model input, so the ranking window is bounded.
    """
    total = importances.agg(F.sum("gain")).scalar()
    share = F.when(total > 0, F.col("gain") / total).otherwise(F.lit(0.0))
    return importances.select(
        "feature",
        F.round("gain", 6).alias("gain"),
        F.round(share, 6).alias("gain_share"),
        (F.col("gain") == 0).alias("dead"),
        F.col("feature").startswith(family).alias("is_keyword_feature"),
        F.row_number().over(Window.orderBy(F.desc("gain"), "feature")).alias("rank"),
    )
