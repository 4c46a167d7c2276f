"""News-window features of events."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.ctes import shortest
from catalog.q_market import labelled
from tidemark.core import interval_rollup
from tidemark.operators import news as nw
from tidemark.operators.documents import mentions
from tidemark.plans.events import apply_heuristic
from tidemark.session import cut_lineage


def named(spark, sf):
    facts = nw.document_facts(
        v.news(spark, sf), v.POSITIVE, v.NEGATIVE, v.GOOD_PHRASES, v.BAD_PHRASES
    )
    return nw.mentioned_facts(facts, v.entities(spark, sf), v.encoder_scores(spark, sf))


_IN_WINDOW = "n.doc_ts BETWEEN e.t_event - INTERVAL 7 DAYS AND e.t_event"


@query(
    "documents_in_window",
    f"""SELECT e.symbol, e.t_event, n.doc_id
        FROM earnings_shifted e JOIN news n ON {_IN_WINDOW}""",
)
def documents_in_window(spark, sf):
    docs = v.news(spark, sf).select("doc_id", "doc_ts")
    return nw.docs_in_window(v.earnings_shifted(spark, sf), docs).select(
        "symbol", "t_event", "doc_id"
    )


@query(
    "documents_in_window_at_midnight",
    f"SELECT e.symbol, e.t_event, n.doc_id FROM earnings e JOIN news n ON {_IN_WINDOW}",
)
def documents_in_window_at_midnight(spark, sf):
    docs = v.news(spark, sf).select("doc_id", "doc_ts")
    return nw.docs_in_window(v.earnings(spark, sf), docs).select("symbol", "t_event", "doc_id")


@query(
    "documents_considered",
    f"""SELECT t_event, count(n.doc_id) AS enhanced_documents_considered
        FROM (SELECT DISTINCT t_event FROM earnings) e LEFT JOIN news n ON {_IN_WINDOW}
        GROUP BY t_event""",
)
def documents_considered(spark, sf):
    return nw.documents_considered(v.earnings(spark, sf), v.news(spark, sf))


@query(
    "spillover_mentions",
    f"""SELECT e.symbol, e.t_event, p.dst, count(*) AS mentions
        FROM earnings_shifted e JOIN edges p ON p.src = e.symbol
        JOIN entities t ON t.symbol = p.dst
        JOIN named m ON m.alias = t.ticker || '|' || t.name AND m.by_ticker = 1
        JOIN news n ON n.doc_id = m.doc_id AND {_IN_WINDOW}
        GROUP BY e.symbol, e.t_event, p.dst""",
)
def spillover_mentions(spark, sf):
    alias_of = nw.keyed_entities(v.entities(spark, sf))
    asked = (
        v.earnings_shifted(spark, sf)
        .join(v.edges(spark, sf).withColumnRenamed("src", "symbol"), "symbol")
        .join(alias_of.select(F.col("symbol").alias("dst"), "alias"), "dst")
    )
    hits = (
        mentions(v.news(spark, sf), alias_of.select("alias", "ticker", "name").distinct(), ["doc_ts"])
        .where("by_ticker = 1")
        .select("alias", "doc_ts", F.lit(1).cast("bigint").alias("mentions"))
    )
    sums = interval_rollup(asked, hits, ["alias"], sums=["mentions"], fact_ts="doc_ts")
    return asked.join(sums, ["alias", "t_event"]).select("symbol", "t_event", "dst", "mentions")


def FEATURES(events: str) -> str:
    return f"""
      SELECT e.symbol, e.t_event, coalesce(o.n, 0) AS sent_doc_count,
        round(coalesce(o.lex_mean, 0), 4) AS sent_lex_mean,
        round(coalesce(o.lex_top, 0), 4) AS sent_lex_max_abs,
        round(coalesce(o.enc_mean, 0), 4) AS sent_enc_mean,
        round(coalesce(o.enc_top, 0), 4) AS sent_enc_max_abs,
        round(coalesce(o.enc_pos / o.enc_n, 0), 4) AS sent_enc_pos_ratio,
        round(coalesce(o.enc_neg / o.enc_n, 0), 4) AS sent_enc_neg_ratio,
        round(coalesce(o.enc_pos / o.enc_n - o.enc_neg / o.enc_n, 0), 4) AS sent_enc_polarity_gap,
        coalesce(o.enc_n, 0) AS sent_enc_doc_count,
        round(coalesce(o.lex_mean, 0), 4) AS sent_mean_score,
        round(coalesce(o.rel_mean, 0), 4) AS sent_mean_relevance,
        coalesce(s.spill, 0) AS spillover_mentions_7d,
        round(coalesce(s.spill, 0) / greatest(1, d.n), 4) AS spillover_density_7d,
        d.n AS enhanced_documents_considered,
        coalesce(o.n, 0) AS enhanced_direct_mentions,
        coalesce(s.spill, 0) AS enhanced_spillover_mentions,
        round(coalesce(s.wspill, 0), 4) AS spillover_weighted_score_7d,
        round(coalesce(o.rel_sum, 0) + 0.35 * coalesce(s.spill, 0) + 0.25 * coalesce(s.wspill, 0), 4)
          AS enhanced_exposure_score,
        coalesce(o.pos_hits, 0) AS earnings_kw_pos_mentions,
        coalesce(o.neg_hits, 0) AS earnings_kw_neg_mentions,
        coalesce(o.pos_docs, 0) AS earnings_kw_pos_doc_count,
        coalesce(o.neg_docs, 0) AS earnings_kw_neg_doc_count,
        round(CASE WHEN o.pos_hits + o.neg_hits > 0
              THEN (o.pos_hits - o.neg_hits) / (o.pos_hits + o.neg_hits) ELSE 0 END, 4)
          AS earnings_kw_polarity,
        round(coalesce((o.pos_hits + o.neg_hits) / greatest(1, o.n), 0), 4) AS earnings_kw_density
      FROM (SELECT DISTINCT symbol, t_event FROM {events}) e
      JOIN (SELECT e.t_event, count(n.doc_id) AS n
            FROM (SELECT DISTINCT t_event FROM {events}) e LEFT JOIN news n ON {_IN_WINDOW}
            GROUP BY e.t_event) d ON d.t_event = e.t_event
      LEFT JOIN (
        SELECT e.symbol, e.t_event, count(*) AS n, avg(n.lex) AS lex_mean,
          max(abs(n.lex)) AS lex_top, avg(n.enc) AS enc_mean, max(abs(n.enc)) AS enc_top,
          nullif(count(n.enc), 0) AS enc_n, count(*) FILTER (n.enc > 0.05) AS enc_pos,
          count(*) FILTER (n.enc < -0.05) AS enc_neg, avg(n.relevance_score) AS rel_mean,
          sum(n.relevance_score) AS rel_sum, CAST(sum(n.pos_hits) AS BIGINT) AS pos_hits,
          CAST(sum(n.neg_hits) AS BIGINT) AS neg_hits,
          count(*) FILTER (n.pos_hits > 0) AS pos_docs, count(*) FILTER (n.neg_hits > 0) AS neg_docs
        FROM {events} e JOIN entities t ON t.symbol = e.symbol
        JOIN named m ON m.alias = t.ticker || '|' || t.name
        JOIN doc_facts n ON n.doc_id = m.doc_id AND {_IN_WINDOW}
        GROUP BY e.symbol, e.t_event) o ON o.symbol = e.symbol AND o.t_event = e.t_event
      LEFT JOIN (
        SELECT e.symbol, e.t_event, count(*) FILTER (p.is_peer) AS spill, sum(p.weight) AS wspill
        FROM {events} e JOIN graph p ON p.src = e.symbol
        JOIN entities t ON t.symbol = p.dst
        JOIN named m ON m.alias = t.ticker || '|' || t.name AND m.by_ticker = 1
        JOIN news n ON n.doc_id = m.doc_id AND {_IN_WINDOW}
        GROUP BY e.symbol, e.t_event) s ON s.symbol = e.symbol AND s.t_event = e.t_event"""


def features(spark, sf, events):
    return nw.news_features(
        events,
        v.news(spark, sf),
        named(spark, sf),
        v.entities(spark, sf),
        v.graph(spark, sf),
    )


@query("news_features", FEATURES("earnings_shifted"))
def news_features(spark, sf):
    return features(spark, sf, v.earnings_shifted(spark, sf))


@query("news_features_at_midnight", FEATURES("earnings"))
def news_features_at_midnight(spark, sf):
    return features(spark, sf, v.earnings(spark, sf))


@query(
    "top_drivers",
    f"""SELECT e.symbol, e.t_event, coalesce(string_agg(x.title, '|' ORDER BY x.rn), '') AS drivers
        FROM (SELECT DISTINCT symbol, t_event FROM earnings_shifted) e LEFT JOIN (
          SELECT e.symbol, e.t_event, n.title, row_number() OVER (
            PARTITION BY e.symbol, e.t_event
            ORDER BY greatest(abs(n.lex), coalesce(abs(n.enc), 0)) + n.relevance_score DESC,
                     n.doc_ts, n.doc_id) AS rn
          FROM earnings_shifted e JOIN entities t ON t.symbol = e.symbol
          JOIN named m ON m.alias = t.ticker || '|' || t.name
          JOIN doc_facts n ON n.doc_id = m.doc_id AND n.title <> '' AND {_IN_WINDOW}
          QUALIFY rn <= 3) x ON x.symbol = e.symbol AND x.t_event = e.t_event
        GROUP BY e.symbol, e.t_event""",
)
def top_drivers(spark, sf):
    listed = nw.top_drivers(
        v.earnings_shifted(spark, sf), named(spark, sf), v.entities(spark, sf)
    )
    return listed.select("symbol", "t_event", F.array_join("top_drivers", "|").alias("drivers"))


HEURISTIC = (
    """
    SELECT x.symbol, x.t_event, x.actual_5d_return_pct, x.actual_sign,
      x.baseline_pre_7d_return_pct, x.baseline_pred_sign,
      CASE WHEN x.baseline_pre_7d_return_pct > 0.1 THEN 1
           WHEN x.baseline_pre_7d_return_pct < -0.1 THEN -1 ELSE 0 END AS enhanced_pred_sign,
      """
    + shortest(
        "least(1e0, 2e-1 + 5e-2 * f.enhanced_direct_mentions + 5e-2 * f.sent_mean_relevance"
        " + 2e-2 * f.enhanced_spillover_mentions + abs(x.baseline_pre_7d_return_pct) / 2e1)"
    )
    + " AS enhanced_confidence FROM ev x JOIN ("
    + FEATURES("ev")
    + ") f ON f.symbol = x.symbol AND f.t_event = x.t_event"
)


@query("heuristic_events", HEURISTIC)
def heuristic_events(spark, sf):
    events = cut_lineage(labelled(spark, sf))
    rows = apply_heuristic(events, features(spark, sf, events))
    return rows.select(*events.columns, "enhanced_pred_sign", "enhanced_confidence")
