"""Accuracy, uplift, coverage and quality."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.q_market import labelled
from catalog.q_news import FEATURES, features
from catalog.q_trades import signalled
from tidemark.operators import evaluation as ev
from tidemark.operators import sessions as ss
from tidemark.operators.documents import lexicon_scorer
from tidemark.operators.folds import walk_forward_folds
from tidemark.plans import events as pe
from tidemark.session import cut_lineage


def _uplift_sql(rows: str) -> str:
    def total(p):
        return f"count(*) FILTER ({p} <> 0 AND actual_sign <> 0)"

    def right(p):
        return f"count(*) FILTER ({p} <> 0 AND {p} = actual_sign)"

    b, e = "baseline_pred_sign", "enhanced_pred_sign"
    return f"""
      SELECT count(*) AS events_in_subset, {total(b)} AS baseline_total, {right(b)} AS baseline_correct,
        {total(e)} AS enhanced_total, {right(e)} AS enhanced_correct,
        round({right(b)} / {total(b)}, 4) AS baseline_accuracy,
        round({right(e)} / {total(e)}, 4) AS enhanced_accuracy,
        round(({right(e)} / {total(e)} - {right(b)} / {total(b)}) * 100.0, 2) AS uplift_pp
      FROM ({rows})"""


@query("uplift", _uplift_sql("SELECT * FROM signals"))
def uplift(spark, sf):
    return ev.uplift(signalled(spark, sf))


@query(
    "subset_uplift",
    _uplift_sql(
        """SELECT * EXCLUDE (enhanced_pred_sign), CASE WHEN enhanced_confidence < 0.5 THEN 0
             ELSE enhanced_pred_sign END AS enhanced_pred_sign
           FROM signals WHERE symbol IN (SELECT symbol FROM company WHERE sector IN ('N1', 'N2', 'N3'))"""
    ),
)
def subset_uplift(spark, sf):
    members = v.company(spark, sf).where(F.col("sector").isin("N1", "N2", "N3"))
    return ev.uplift(ss.filter_signals(signalled(spark, sf), members, min_confidence=0.5))


_ROWS = FEATURES("earnings_shifted")


def feature_rows(spark, sf):
    return features(spark, sf, v.earnings_shifted(spark, sf))


@query(
    "coverage_summary",
    f"""SELECT count(*) AS events_total, count(*) FILTER (sent_doc_count > 0) AS events_with_any_news,
          count(*) FILTER (sent_enc_doc_count > 0) AS events_with_encoder_score,
          count(*) FILTER (spillover_mentions_7d > 0) AS events_with_spillover,
          round(count(*) FILTER (sent_doc_count = 0) / count(*), 4) AS zero_news_event_pct,
          round(count(*) FILTER (enhanced_documents_considered > 0) / count(*), 4) AS enhanced_feature_coverage,
          round(count(*) FILTER (enhanced_documents_considered > 0 AND spillover_mentions_7d > 0)
            / count(*) FILTER (enhanced_documents_considered > 0), 4) AS spillover_coverage_within_enhanced,
          round(count(*) FILTER (sent_enc_doc_count > 0) / count(*), 4) AS encoder_feature_coverage
        FROM ({_ROWS})""",
)
def coverage_summary(spark, sf):
    return ev.coverage_summary(feature_rows(spark, sf))


@query(
    "low_coverage_symbols",
    f"""SELECT symbol, events, events_with_news, round(events_with_news / events, 4) AS coverage_pct
        FROM (SELECT symbol, count(*) AS events, count(*) FILTER (sent_doc_count > 0) AS events_with_news
              FROM ({_ROWS}) GROUP BY symbol)
        WHERE events >= 4 AND events_with_news / events < 0.25
        ORDER BY coverage_pct, events DESC, symbol LIMIT 25""",
)
def low_coverage_symbols(spark, sf):
    return ev.low_coverage_symbols(feature_rows(spark, sf))


@query(
    "data_quality",
    f"""SELECT count(*) AS events_labeled, count(DISTINCT symbol) AS symbols,
          round(count(*) FILTER (sent_doc_count = 0) / count(*), 4) AS zero_news_event_pct,
          round(count(*) FILTER (enhanced_documents_considered > 0) / count(*), 4) AS enhanced_feature_coverage,
          round(count(*) FILTER (sent_enc_doc_count > 0) / count(*), 4) AS encoder_feature_coverage,
          concat_ws(',', CASE WHEN count(*) < 60 THEN 'few_events' END,
            CASE WHEN count(*) FILTER (sent_doc_count = 0) / count(*) > 0.5 THEN 'zero_news' END,
            CASE WHEN count(*) FILTER (enhanced_documents_considered > 0) / count(*) < 0.25
                 THEN 'sparse_features' END,
            CASE WHEN count(*) FILTER (sent_enc_doc_count > 0) > 0
                  AND count(*) FILTER (sent_enc_doc_count > 0) / count(*) < 0.1 THEN 'sparse_encoder' END)
            AS warnings
        FROM ({_ROWS})""",
)
def data_quality(spark, sf):
    rows = ev.data_quality(feature_rows(spark, sf))
    return rows.withColumn("warnings", F.array_join("warnings", ","))


@query(
    "classification_metrics",
    """SELECT count(*) AS n_test, round(avg(CAST(y = p AS INTEGER)), 6) AS accuracy,
         round(coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (p = 1), 0), 0), 6) AS precision,
         round(coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS recall,
         round(coalesce(2 * count(*) FILTER (y = 1 AND p = 1)
           / nullif(count(*) FILTER (p = 1) + count(*) FILTER (y = 1), 0), 0), 6) AS f1
       FROM (SELECT l.quality AS y, CASE WHEN f.lex > 0 THEN 1 ELSE 0 END AS p
             FROM labels l JOIN doc_facts f ON f.doc_id = CAST(l.doc_id AS VARCHAR))""",
)
def classification_metrics(spark, sf):
    scored = lexicon_scorer(v.POSITIVE, v.NEGATIVE)(v.news(spark, sf))
    rows = v.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").alias("label")
    )
    said = scored.select("doc_id", (F.col("score") > 0).cast("int").alias("prediction"))
    return ev.classification_metrics(rows.join(said, "doc_id"))


@query(
    "fold_mean_accuracy",
    """SELECT round(avg(acc), 4) AS fold_mean_accuracy, count(*) AS folds FROM (
         SELECT (ord - 48) // 12 AS fold, round(avg(CAST((actual_sign > 0) = (baseline_pre_7d_return_pct > 0)
             AS INTEGER)), 6) AS acc
         FROM (SELECT *, row_number() OVER (ORDER BY t_event, symbol) - 1 AS ord
               FROM signals WHERE actual_sign <> 0)
         WHERE ord >= 48 GROUP BY 1)""",
)
def fold_mean_accuracy(spark, sf):
    rows = pe.labelled(signalled(spark, sf)).withColumn(
        "prediction", (F.col("baseline_pre_7d_return_pct") > 0).cast("int")
    )
    folded = walk_forward_folds(cut_lineage(rows)).where(F.col("fold_id").isNotNull())
    return ev.fold_mean_accuracy(ev.classification_metrics(folded, by=["fold_id"]))


@query(
    "rescore_summary",
    """SELECT count(*) AS events, count(*) FILTER (baseline_pred_sign <> enhanced_pred_sign) AS sign_flips_vs_prior,
         round(avg(enhanced_confidence - 0.4), 6) AS mean_confidence_delta,
         round(avg(abs(enhanced_confidence - 0.4)), 6) AS mean_abs_confidence_delta FROM signals""",
)
def rescore_summary(spark, sf):
    new = cut_lineage(signalled(spark, sf))
    old = new.select(
        "symbol",
        "t_event",
        F.col("baseline_pred_sign").alias("enhanced_pred_sign"),
        F.lit(0.4).alias("enhanced_confidence"),
    )
    return ev.rescore_summary(old, new)


@query(
    "dashboard_events",
    """SELECT symbol, t_event, actual_5d_return_pct, enhanced_pred_sign FROM signals
       ORDER BY t_event, symbol LIMIT 8""",
)
def dashboard_events(spark, sf):
    rows = signalled(spark, sf).select("symbol", "t_event", "actual_5d_return_pct", "enhanced_pred_sign")
    return ev.dashboard_events(rows)


@query(
    "labelled_events",
    """SELECT symbol, t_event, actual_sign, CAST(actual_sign > 0 AS INTEGER) AS label
       FROM ev WHERE actual_sign <> 0""",
)
def labelled_events(spark, sf):
    return pe.labelled(labelled(spark, sf)).select("symbol", "t_event", "actual_sign", "label")
