"""Splits, folds, selection lanes, fits and forward signals."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.ctes import shortest
from catalog.q_market import enriched_sql
from catalog.q_news import FEATURES, HEURISTIC, named
from catalog.q_trades import DRAWN, metrics_sql, signalled, with_digits
from tidemark import fixed_values as fx
from tidemark.core import exact_median
from tidemark.operators import evaluation as ev
from tidemark.operators import folds as fd
from tidemark.operators import model as md
from tidemark.operators.trades import strategy_metrics
from tidemark.plans import backtest as bt
from tidemark.plans import events as pe
from tidemark.plans import forward as fw
from tidemark.plans import permutation as pm
from tidemark.session import cut_lineage
from tidemark.streaming.jobs import work_dir

_ORD = "row_number() OVER (ORDER BY t_event, symbol) - 1"
_N = "(SELECT count(*) FROM signals)"


@query(
    "time_split",
    f"""SELECT symbol, t_event, ord, CASE WHEN ord < least(greatest(1, CAST(floor({_N} * 7e-1) AS BIGINT)), {_N} - 1)
          THEN 'train' ELSE 'test' END AS role
        FROM (SELECT symbol, t_event, {_ORD} AS ord FROM signals)""",
)
def time_split(spark, sf):
    events = cut_lineage(signalled(spark, sf))
    return fd.time_split(events).select("symbol", "t_event", "ord", "role")


@query(
    "locked_holdout",
    """SELECT symbol, t_event, t_event > (SELECT max(t_event) - INTERVAL 90 DAYS FROM signals) AS holdout
       FROM signals""",
)
def locked_holdout(spark, sf):
    events = cut_lineage(signalled(spark, sf))
    return fd.partition_holdout(events).select("symbol", "t_event", "holdout")


_FOLDED = f"""
    SELECT *, CASE WHEN ord >= 48 THEN CAST((ord - 48) // 12 AS INTEGER) END AS fold_id
    FROM (SELECT *, {_ORD} AS ord FROM signals)"""


def folded(spark, sf):
    rows = cut_lineage(signalled(spark, sf))
    scored = fd.walk_forward_folds(rows).withColumns(
        {
            "signal": F.col("enhanced_pred_sign"),
            "confidence": F.col("enhanced_confidence"),
        }
    )
    return cut_lineage(scored)


@query("walk_forward_folds", f"SELECT symbol, t_event, ord, fold_id FROM ({_FOLDED})")
def walk_forward_folds(spark, sf):
    return folded(spark, sf).select("symbol", "t_event", "ord", "fold_id")


@query(
    "fold_table",
    f"""SELECT fold_id, count(*) AS test_events, min(t_event) AS test_start, max(t_event) AS test_end,
          CAST(48 + fold_id * 12 AS BIGINT) AS train_events
        FROM ({_FOLDED}) WHERE fold_id IS NOT NULL GROUP BY fold_id""",
)
def fold_table(spark, sf):
    return fd.fold_table(folded(spark, sf))


@query(
    "momentum_predictions",
    f"""SELECT symbol, t_event, CAST(x > 0 AS INTEGER) AS prediction, CASE WHEN x > 0 THEN 1 ELSE -1 END AS signal,
         {shortest('greatest(5e-1, least(95e-2, 5e-1 + abs(x) / 24e0))', 6)} AS proba
       FROM (SELECT symbol, t_event, baseline_pre_7d_return_pct AS x FROM signals)""",
)
def momentum_predictions(spark, sf):
    rows = md.momentum_predict(signalled(spark, sf))
    return rows.select("symbol", "t_event", "prediction", "signal", F.round("proba", 6).alias("proba"))


# --- selection lanes on a given confidence -----------------------------------

_PICKED = f"""
    SELECT *, signal <> 0 AND row_number() OVER (
      PARTITION BY fold_id, signal ORDER BY confidence DESC, t_event, symbol) <= 1 AS taken
    FROM (SELECT *, enhanced_pred_sign AS signal, enhanced_confidence AS confidence FROM ({_FOLDED}))
    WHERE fold_id IS NOT NULL"""


@query(
    "top_k_signals",
    f"SELECT fold_id, symbol, t_event, signal, confidence FROM ({_PICKED}) WHERE taken",
)
def top_k_signals(spark, sf):
    tested = folded(spark, sf).where(F.col("fold_id").isNotNull())
    return fd.top_k_signals(tested, ["fold_id"]).select(
        "fold_id", "symbol", "t_event", "signal", "confidence"
    )


_NET = shortest("signal * actual_5d_return_pct - 1e-1")


@query(
    "top_k_lane",
    f"""SELECT symbol, t_event, fold_id, taken, {_NET} AS net_return_pct FROM ({_PICKED})""",
)
def top_k_lane(spark, sf):
    tested = folded(spark, sf).where(F.col("fold_id").isNotNull())
    return fd.top_k_lane(tested).select("symbol", "t_event", "fold_id", "taken", "net_return_pct")


_MONTHS = "greatest(1, floor((epoch(max({t})) - epoch(min({t}))) / 86400) / 30.0)"
_THRESHOLDS = f"""
    WITH rows_in AS ({_FOLDED}), sized AS (
      SELECT f.fold_id, least(greatest(1, CAST(round_even(3.0 * {_MONTHS.format(t='r.t_event')}, 0) AS INTEGER)),
                              count(*)) AS k
      FROM (SELECT DISTINCT fold_id FROM rows_in WHERE fold_id IS NOT NULL) f
      JOIN rows_in r ON r.ord < 48 + 12 * f.fold_id GROUP BY f.fold_id)
    SELECT s.fold_id, r.enhanced_confidence AS threshold
    FROM sized s JOIN rows_in r ON r.ord < 48 + 12 * s.fold_id
    QUALIFY row_number() OVER (PARTITION BY s.fold_id
      ORDER BY r.enhanced_confidence DESC, r.t_event, r.symbol) = any_value(s.k) OVER (PARTITION BY s.fold_id)"""


def thresholds(rows):
    return fd.confidence_thresholds(rows)


@query("confidence_thresholds", _THRESHOLDS)
def confidence_thresholds(spark, sf):
    return thresholds(folded(spark, sf))


@query(
    "threshold_lane",
    f"""SELECT f.symbol, f.t_event, f.fold_id, f.enhanced_confidence >= t.threshold AS taken
        FROM ({_FOLDED}) f JOIN ({_THRESHOLDS}) t ON t.fold_id = f.fold_id""",
)
def threshold_lane(spark, sf):
    rows = folded(spark, sf)
    lane = fd.threshold_lane(rows.where(F.col("fold_id").isNotNull()), thresholds(rows))
    return lane.select("symbol", "t_event", "fold_id", "taken")


_PART = """SELECT *, enhanced_pred_sign AS signal, enhanced_confidence AS confidence,
    t_event > (SELECT max(t_event) - INTERVAL 90 DAYS FROM signals) AS held FROM signals"""
_SCALED = """(SELECT greatest(1, CAST(round_even(greatest(1.0,
    floor((epoch(max(t_event)) - epoch(min(t_event))) / 86400)) / 30.0, 0) AS INTEGER)) FROM held)"""
_LEVEL = f"""(SELECT confidence FROM (SELECT confidence, row_number() OVER (ORDER BY confidence DESC, t_event, symbol) AS rn
      FROM parts WHERE NOT held) WHERE rn = (
      SELECT least(greatest(1, CAST(round_even(3.0 * {_MONTHS.format(t='t_event')}, 0) AS INTEGER)), count(*))
      FROM parts WHERE NOT held))"""
_HOLDOUT = f"""
    WITH parts AS ({_PART}), held AS (SELECT * FROM parts WHERE held)
    SELECT 'top_k' AS lane, symbol, t_event, signal <> 0 AND row_number() OVER (
      PARTITION BY signal ORDER BY confidence DESC, t_event, symbol) <= {_SCALED} AS taken, {_NET} AS net_return_pct
    FROM held
    UNION ALL
    SELECT 'threshold', symbol, t_event, confidence >= {_LEVEL}, {_NET} FROM held"""


@query("holdout_lanes", _HOLDOUT)
def holdout_lanes(spark, sf):
    marked = fd.partition_holdout(cut_lineage(signalled(spark, sf))).withColumns(
        {"signal": F.col("enhanced_pred_sign"), "confidence": F.col("enhanced_confidence")}
    )
    marked = cut_lineage(marked)
    lanes = fd.holdout_lanes(marked.where(~F.col("holdout")), marked.where("holdout"))
    return lanes.select("lane", "symbol", "t_event", "taken", "net_return_pct")


@query(
    "holdout_metrics",
    f"""SELECT lane, {DRAWN}
        FROM ({metrics_sql(f"(SELECT *, 1.0 AS position_weight FROM ({_HOLDOUT}))", "lane", order="t_event, symbol")})""",
)
def holdout_metrics(spark, sf):
    marked = fd.partition_holdout(cut_lineage(signalled(spark, sf))).withColumns(
        {"signal": F.col("enhanced_pred_sign"), "confidence": F.col("enhanced_confidence")}
    )
    marked = cut_lineage(marked)
    lanes = fd.holdout_lanes(marked.where(~F.col("holdout")), marked.where("holdout"))
    metrics = strategy_metrics(cut_lineage(lanes), ["lane"], fd.event_order(), fd.event_chunks())
    return with_digits(metrics)


@query(
    "median_by_strategy",
    "SELECT strategy, round(median(actual_5d_return_pct), 6) AS median FROM trades GROUP BY strategy",
)
def median_by_strategy(spark, sf):
    out = exact_median(v.trades(spark, sf), "actual_5d_return_pct", ["strategy"])
    return out.withColumn("median", F.round("median", 6))


# --- event frame -------------------------------------------------------------


def evaluated(spark, sf, with_paths=False):
    return pe.evaluate_events(
        v.earnings_shifted(spark, sf),
        v.bars(spark, sf),
        v.news(spark, sf),
        cut_lineage(named(spark, sf)),
        v.entities(spark, sf),
        v.company(spark, sf),
        v.graph(spark, sf),
        v.hedges(spark, sf) if with_paths else None,
    )


def frame(spark, sf):
    return cut_lineage(pe.feature_frame(evaluated(spark, sf)))


_ABS = "baseline_pre_7d_abs_return"
_FRAME = f"""
    SELECT x.symbol, x.t_event, CAST(x.actual_sign > 0 AS INTEGER) AS label, x.actual_5d_return_pct,
      abs(x.baseline_pre_7d_return_pct) AS {_ABS},
      {", ".join(f"CAST(coalesce(x.{c}, 0) AS DOUBLE) AS {c}" for c in fx.PRICE_FEATURES if c != _ABS)},
      {", ".join(f"CAST(coalesce(f.{c}, 0) AS DOUBLE) AS {c}" for c in fx.TEXT_FEATURES)}
    FROM ({enriched_sql('ev')}) x
    JOIN ({FEATURES('ev')}) f ON f.symbol = x.symbol AND f.t_event = x.t_event
    WHERE x.actual_sign <> 0"""


@query("feature_frame", _FRAME)
def feature_frame(spark, sf):
    return pe.feature_frame(evaluated(spark, sf)).select(
        "symbol", "t_event", "label", "actual_5d_return_pct", *fx.ENHANCED_FEATURES
    )


_TRAINED = "t_event < TIMESTAMP '1999-01-01 00:00:00'"


@query(
    "standardised_features",
    f"""WITH frame AS MATERIALIZED ({_FRAME}), moments AS (
          SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in fx.ENHANCED_FEATURES)}
          FROM frame WHERE {_TRAINED})
        SELECT symbol, t_event, {", ".join(
            f"round(({c} - m_{c}) / CASE WHEN s_{c} >= 1e-9 THEN s_{c} ELSE 1 END, 6) AS {c}"
            for c in fx.ENHANCED_FEATURES)}
        FROM frame, moments""",
)
def standardised_features(spark, sf):
    events = frame(spark, sf)
    train = events.where(F.col("t_event") < F.lit("1999-01-01").cast("timestamp_ntz"))
    names = fx.ENHANCED_FEATURES
    out = md.standardize(events, names, *md.feature_moments(train, names))
    return out.select("symbol", "t_event", *[F.round(c, 6).alias(c) for c in names])


@query("evaluated_events", f"""
    SELECT symbol, t_event, enhanced_pred_sign, enhanced_confidence, actual_sign FROM ({HEURISTIC})""")
def evaluated_events(spark, sf):
    return evaluated(spark, sf).select(
        "symbol", "t_event", "enhanced_pred_sign", "enhanced_confidence", "actual_sign"
    )


# --- fits (no SQL: iterative) ------------------------------------------------


@query("classifier_on_test_fold")
def classifier_on_test_fold(spark, sf):
    split = cut_lineage(fd.time_split(frame(spark, sf)))
    train, test = (split.where(F.col("role") == r) for r in ("train", "test"))
    scored = md.fit_predict(train, test, fx.ENHANCED_FEATURES, "trees")
    return ev.classification_metrics(scored)


@query("stored_model_predictions")
def stored_model_predictions(spark, sf):
    """Predictions of a model that was written and read back."""
    rows = frame(spark, sf)
    path = work_dir(spark, "model")
    md.save_model(md.fit_classifier(rows, fx.PRICE_FEATURES, "logistic"), path, spark)
    return md.predict(md.load_model(path, spark), rows).select(
        "symbol", "t_event", F.round("proba", 6).alias("proba"), "signal"
    )


@query(
    "reloaded_model",
    f"""SELECT count(*) AS events, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS altered
        FROM ({_FRAME})""",
)
def reloaded_model(spark, sf):
    """A model read back predicts the same, and predicting leaves the inputs alone."""
    rows = frame(spark, sf)
    path = work_dir(spark, "model")
    model = md.fit_classifier(rows, fx.ENHANCED_FEATURES, "logistic")
    md.save_model(model, path, spark)
    keys = ["symbol", "t_event"]
    inputs = F.struct(*fx.ENHANCED_FEATURES)
    before = md.predict(model, rows).select(*keys, "proba", "signal", inputs.alias("x"))
    after = md.predict(md.load_model(path, spark), rows).select(
        *keys, F.col("proba").alias("proba2"), F.col("signal").alias("signal2")
    )
    given = rows.select(*keys, inputs.alias("given"))
    same = (F.col("proba") == F.col("proba2")) & (F.col("signal") == F.col("signal2"))
    return (
        given.join(before, keys)
        .join(after, keys)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(~same).alias("differing"),
            F.count_if(F.col("x") != F.col("given")).alias("altered"),
        )
    )


@query(
    "separable_fit",
    f"""SELECT count(*) AS events, CAST(0 AS BIGINT) AS mistakes, CAST(0 AS BIGINT) AS unsure
        FROM ({_FRAME})""",
)
def separable_fit(spark, sf):
    """Boosted trees learn a label that one feature decides, without a mistake."""
    step = F.pmod(F.floor(F.abs("baseline_pre_7d_return_pct") * 10), F.lit(5)).cast("double")
    rows = frame(spark, sf).withColumn("step", step)
    rows = cut_lineage(rows.withColumn("label", (F.col("step") >= 3).cast("int")))
    scored = md.fit_predict(rows, rows, ["sent_doc_count", "step"], "trees")
    return scored.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("prediction") != F.col("label")).alias("mistakes"),
        F.count_if(F.col("confidence") < 0.9).alias("unsure"),
    )


@query("model_comparison")
def model_comparison(spark, sf):
    return bt.compare_models(frame(spark, sf))


@query("subset_model_comparison")
def subset_model_comparison(spark, sf):
    members = v.company(spark, sf).where(F.col("sector").isin("N1", "N2", "N3", "N4", "N5", "N6"))
    return bt.compare_models(frame(spark, sf), members)


@query("tree_feature_importance")
def tree_feature_importance(spark, sf):
    model = md.fit_classifier(frame(spark, sf), fx.ENHANCED_FEATURES, "trees")
    return ev.feature_importance(md.importances(model, spark))


@query("permutation_feature_importance")
def permutation_feature_importance(spark, sf):
    train = fd.time_split(frame(spark, sf)).where(F.col("role") == "train").drop("ord")
    return md.permutation_importance(cut_lineage(train), fx.ENHANCED_FEATURES)


@query("walk_forward_lanes")
def walk_forward_lanes(spark, sf):
    """Metrics of the three walk-forward lanes on both feature sets."""
    folded = bt.folded_frame(frame(spark, sf))
    runs = [
        bt.walk_forward_backtest(folded, features, name)["trades"]
        for name, features in (("enhanced", fx.ENHANCED_FEATURES), ("baseline", fx.PRICE_FEATURES))
    ]
    return strategy_metrics(
        cut_lineage(runs[0].unionByName(runs[1])), ["strategy"], fd.event_order(), fd.event_chunks()
    )


@query("full_backtest")
def full_backtest(spark, sf):
    """Metrics of all nine return lanes and both path lanes, and which one is best."""
    rows = cut_lineage(evaluated(spark, sf, with_paths=True))
    report = bt.full_backtest(cut_lineage(pe.feature_frame(rows)), rows)
    best = report["best"].select("strategy", F.lit(True).alias("best"))
    return (
        report["metrics"]
        .unionByName(report["path_metrics"], allowMissingColumns=True)
        .join(best, "strategy", "left")
        .withColumn("best", F.coalesce("best", F.lit(False)))
    )


@query("permutation_test")
def permutation_test(spark, sf):
    """Four strategies against 200 shuffles each."""
    return pm.permutation_test(frame(spark, sf), n_perm=200)


@query("permutation_search")
def permutation_search(spark, sf):
    scored = pm.walk_forward_scores(
        frame(spark, sf), fx.ENHANCED_FEATURES, 200, "symbol_block", 42
    )
    return pm.permutation_search(scored)


# --- forward signals ---------------------------------------------------------

_LIVE = f"""
    SELECT symbol, d AS last_d, close AS spot,
      CASE WHEN then_close <> 0 THEN (close - then_close) / then_close * 100.0 END AS pre
    FROM (SELECT symbol, d, close, lag(close, 7) OVER (PARTITION BY symbol ORDER BY d) AS then_close
          FROM bars WHERE d BETWEEN DATE '{v.AS_OF}' - INTERVAL 45 DAYS AND DATE '{v.AS_OF}')
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1"""
_COMING = f"""
    SELECT symbol, min(t_event) AS t_event FROM earnings_shifted
    WHERE t_event BETWEEN TIMESTAMP '{v.AS_OF} 00:00:00' AND TIMESTAMP '{v.AS_OF} 00:00:00' + INTERVAL 14 DAYS
    GROUP BY symbol"""
_PAPER = f"""
    WITH coming AS ({_COMING}), feats AS ({FEATURES('coming').replace('%', '%')}), base AS (
      SELECT c.symbol, c.t_event, l.pre, l.spot, l.last_d, f.sent_doc_count, f.spillover_mentions_7d,
        CASE WHEN l.pre > 0.1 THEN 1 WHEN l.pre < -0.1 THEN -1 ELSE 0 END AS signal,
        round(least(1.0, 0.2 + 0.05 * f.enhanced_direct_mentions + 0.05 * f.sent_mean_relevance
          + 0.02 * f.enhanced_spillover_mentions + abs(l.pre) / 20.0), 4) AS confidence
      FROM coming c JOIN ({_LIVE}) l ON l.symbol = c.symbol JOIN feats f ON f.symbol = c.symbol
      WHERE l.pre IS NOT NULL), planned AS (
      SELECT *, round(greatest(1.0, least(8.0, 0.45 * abs(pre)
                  + 0.65 * greatest(1.0, least(4.0, abs(pre) / 3.0)))), 4) AS stop_pct FROM base)
    SELECT p.symbol, n.name, n.sector, p.t_event,
      CAST(greatest(0, date_diff('day', DATE '{v.AS_OF}', CAST(p.t_event AS DATE))) AS INTEGER) AS days_to_earnings,
      signal, CASE WHEN signal > 0 THEN 'bullish' WHEN signal < 0 THEN 'bearish' ELSE 'mixed' END AS direction,
      confidence, {shortest('least(1e0, greatest(25e-2, 25e-2 + confidence * 75e-2))')} AS position_weight,
      round(pre, 4) AS baseline_pre_7d_return_pct, sent_doc_count, spillover_mentions_7d,
      signal <> 0 AND confidence >= 0.15 AS actionable,
      CASE WHEN live THEN round(spot, 4) END AS entry_price,
      CASE WHEN live THEN round(spot * (1 - signal * stop_pct / 100.0), 4) END AS stop_price,
      CASE WHEN live THEN round(spot * (1 + signal * round(greatest(1.5 * stop_pct, 0.55 * abs(pre)), 4) / 100.0), 4)
        END AS target_price,
      CASE WHEN signal < 0 THEN h.hedge END AS suggested_hedge
    FROM (SELECT *, last_d >= DATE '{v.AS_OF}' - 5 AND signal <> 0 AS live FROM planned) p
    JOIN company n ON n.symbol = p.symbol LEFT JOIN hedges h ON h.sector = n.sector"""


@query("paper_signals", _PAPER)
def paper_signals(spark, sf):
    signals = fw.paper_signals(
        v.company(spark, sf),
        v.earnings_shifted(spark, sf),
        v.bars(spark, sf),
        v.news(spark, sf),
        cut_lineage(named(spark, sf)),
        v.entities(spark, sf),
        v.edges(spark, sf),
        v.hedges(spark, sf),
        v.AS_OF,
    )
    return fw.rank_signals(signals)


@query("rescored_events")
def rescored_events(spark, sf):
    """Stored heuristic events scored again by a fitted model."""
    rows = cut_lineage(evaluated(spark, sf))
    model = md.fit_classifier(
        cut_lineage(pe.feature_frame(rows)), fx.ENHANCED_FEATURES, "logistic"
    )
    again = fw.apply_enhanced(rows.drop("enhanced_pred_sign", "enhanced_confidence"), model)
    return ev.rescore_summary(rows, again)


