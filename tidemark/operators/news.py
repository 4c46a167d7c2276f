"""News features of an event from the documents of its look-back window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core import interval_join, interval_rollup, top_by
from tidemark.core.timelines import total_at
from tidemark.functions import text as tx
from tidemark.operators.documents import mentions


FACTS = ("doc_ts", "headline", "relevance_score", "lex", "pos_hits", "neg_hits")


def document_facts(
    docs: DataFrame,
    positive: Sequence[str] = fx.LEXICON_POSITIVE,
    negative: Sequence[str] = fx.LEXICON_NEGATIVE,
    outcome_positive: Sequence[str] = fx.OUTCOME_POSITIVE_PATTERNS,
    outcome_negative: Sequence[str] = fx.OUTCOME_NEGATIVE_PATTERNS,
    lexicon_scores: DataFrame | None = None,
) -> DataFrame:
    """Documents with the numbers that features need from their text.

    Where ``lexicon_scores`` (``doc_id``, ``score``) holds a document's lexicon
    score, the stored one stands and the text is not scored again.
    """
    text = tx.headline_and_body(F.col("title"), F.col("body"))
    lex = tx.lexicon_score(text, positive, negative)
    if lexicon_scores is not None:
        known = lexicon_scores.select("doc_id", F.col("score").cast("double").alias("__stored"))
        docs = docs.join(known, "doc_id", "left")
        lex = F.coalesce(F.col("__stored"), lex)
    return docs.select(
        "doc_id",
        "doc_ts",
        "title",
        "body",
        F.trim("title").alias("headline"),
        "relevance_score",
        lex.alias("lex"),
        tx.pattern_hits(text, outcome_positive).alias("pos_hits"),
        tx.pattern_hits(text, outcome_negative).alias("neg_hits"),
    )


def mentioned_facts(
    facts: DataFrame,
    entities: DataFrame,
    encoder_scores: DataFrame | None = None,
) -> DataFrame:
    """Per (document, alias) the document's numbers; texts are read once, here.

    Only these narrow rows are shuffled. A job that serves several features
    should store this table.
    """
    aliases = keyed_entities(entities).select("alias", "ticker", "name").distinct()
    named = mentions(facts, aliases, keep=FACTS)
    if encoder_scores is None:
        return named.withColumn("enc", F.lit(None).cast("double"))
    return named.join(
        encoder_scores.select("doc_id", F.col("score").alias("enc")), "doc_id", "left"
    )


def keyed_entities(entities: DataFrame) -> DataFrame:
    """Entities with the alias that stands for their terms."""
    name = F.lower("name")
    return entities.select(
        "symbol", "ticker", name.alias("name"), F.concat_ws("|", "ticker", name).alias("alias")
    )


def docs_in_window(events: DataFrame, docs: DataFrame, days: int = 7) -> DataFrame:
    """(event, document) pairs with the document in the closed ``[T - days, T]``."""
    return interval_join(events, docs, fact_ts="doc_ts", days=days)


def documents_considered(events: DataFrame, docs: DataFrame, days: int = 7) -> DataFrame:
    """Documents in the window of each event time, as a difference of running totals."""
    reach = F.expr(f"INTERVAL {int(days)} DAYS")
    times = events.select("t_event").distinct()
    # At one instant: the window opens before its documents, and closes after them.
    ends = F.explode(
        F.array(
            F.struct(F.col("t_event").alias("at"), F.lit(1).alias("rank")),
            F.struct((F.col("t_event") - reach).alias("at"), F.lit(-1).alias("rank")),
        )
    )
    totals = total_at(
        times.select(ends.alias("e")).select("e.*"),
        docs.select(F.col("doc_ts").alias("at"), F.lit(1).alias("change"), F.lit(0).alias("rank")),
        [],
        "at",
    )
    t_event = F.when(F.col("rank") > 0, F.col("at")).otherwise(F.col("at") + reach)
    return totals.groupBy(t_event.alias("t_event")).agg(
        F.sum(F.col("total") * F.col("rank")).alias("enhanced_documents_considered")
    )


_SUMS = (
    "n_docs", "n_ticker", "lex_sum", "rel_sum", "enc_sum", "enc_n", "enc_pos", "enc_neg",
    "pos_hits", "neg_hits", "pos_docs", "neg_docs",
)
_MAXIMA = ("lex_top", "enc_top")


def _contributions(named: DataFrame) -> DataFrame:
    """What each (document, alias) adds to the alias's sums."""

    def one_if(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("bigint")

    return named.select(
        "alias",
        "doc_ts",
        F.lit(1).cast("bigint").alias("n_docs"),
        F.col("by_ticker").cast("bigint").alias("n_ticker"),
        F.col("lex").alias("lex_sum"),
        F.col("relevance_score").alias("rel_sum"),
        F.col("enc").alias("enc_sum"),
        one_if(F.col("enc").isNotNull()).alias("enc_n"),
        one_if(F.col("enc") > 0.05).alias("enc_pos"),
        one_if(F.col("enc") < -0.05).alias("enc_neg"),
        F.col("pos_hits").cast("bigint").alias("pos_hits"),
        F.col("neg_hits").cast("bigint").alias("neg_hits"),
        one_if(F.col("pos_hits") > 0).alias("pos_docs"),
        one_if(F.col("neg_hits") > 0).alias("neg_docs"),
        F.abs("lex").alias("lex_top"),
        F.abs("enc").alias("enc_top"),
    )


def news_features(
    events: DataFrame,
    docs: DataFrame,
    named: DataFrame,
    entities: DataFrame,
    edges: DataFrame,
    days: int = 7,
) -> DataFrame:
    """Sentiment, phrase and spillover features of each event's window.

    ``named`` comes from ``mentioned_facts``; of ``docs`` only the time is read.
    Symbols with equal terms share one alias, so a mention is counted once per
    alias. Own and neighbour sums come from one roll-up per (alias, T). An edge
    with ``is_peer`` false only adds its weight; without that column all edges
    are peers.
    """
    alias_of = keyed_entities(entities).select("symbol", "alias")
    keys = events.select("symbol", "t_event").distinct()
    # One row per event and alias it looks at: its own, then its neighbours'.
    own_edge = alias_of.select("symbol", F.col("symbol").alias("dst"), "alias").withColumns(
        {"weight": F.lit(None).cast("double"), "is_peer": F.lit(False)}
    )
    is_peer = F.col("is_peer") if "is_peer" in edges.columns else F.lit(True)
    peer_edge = edges.select(
        F.col("src").alias("symbol"), "dst", "weight", F.coalesce(is_peer, F.lit(True)).alias("is_peer")
    ).join(alias_of.withColumnRenamed("symbol", "dst"), "dst")
    looks = own_edge.unionByName(
        peer_edge.select("symbol", "dst", "alias", "weight", "is_peer")
    )
    asked = keys.join(looks, "symbol")
    sums = interval_rollup(
        asked, _contributions(named), ["alias"], sums=_SUMS, maxima=_MAXIMA,
        fact_ts="doc_ts", days=days,
    )
    own = F.col("symbol") == F.col("dst")
    picked = (
        asked.join(sums, ["alias", "t_event"])
        .groupBy("symbol", "t_event")
        .agg(
            *[F.max(F.when(own, F.col(c))).alias(c) for c in (*_SUMS, *_MAXIMA)],
            F.sum(F.when(F.col("is_peer"), F.col("n_ticker")).otherwise(0)).alias("spill"),
            F.sum(
                F.when(~own, F.col("n_ticker") * F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
            ).alias("weighted_spill"),
        )
    )
    return _feature_columns(
        keys.join(picked, ["symbol", "t_event"], "left").join(
            documents_considered(keys, docs, days), "t_event", "left"
        )
    )


def _feature_columns(rows: DataFrame) -> DataFrame:
    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def mean(total: str, n: str) -> Column:
        return F.when(zero(n) > 0, F.col(total) / F.col(n)).otherwise(F.lit(0.0))

    n, spill, wspill = zero("n_docs"), zero("spill"), zero("weighted_spill")
    considered = zero("enhanced_documents_considered")
    mentions_total = zero("pos_hits") + zero("neg_hits")
    pos_ratio, neg_ratio = mean("enc_pos", "enc_n"), mean("enc_neg", "enc_n")
    out = {
        "sent_doc_count": n,
        "sent_lex_mean": F.round(mean("lex_sum", "n_docs"), 4),
        "sent_lex_max_abs": F.round(F.coalesce("lex_top", F.lit(0.0)), 4),
        "sent_enc_mean": F.round(mean("enc_sum", "enc_n"), 4),
        "sent_enc_max_abs": F.round(F.coalesce("enc_top", F.lit(0.0)), 4),
        "sent_enc_pos_ratio": F.round(pos_ratio, 4),
        "sent_enc_neg_ratio": F.round(neg_ratio, 4),
        "sent_enc_polarity_gap": F.round(pos_ratio - neg_ratio, 4),
        "sent_enc_doc_count": zero("enc_n"),
        "sent_mean_score": F.round(mean("lex_sum", "n_docs"), 4),
        "sent_mean_relevance": F.round(mean("rel_sum", "n_docs"), 4),
        "spillover_mentions_7d": spill,
        "spillover_density_7d": F.round(spill / F.greatest(F.lit(1), considered), 4),
        "enhanced_documents_considered": considered,
        "enhanced_direct_mentions": n,
        "enhanced_spillover_mentions": spill,
        "spillover_weighted_score_7d": F.round(wspill, 4),
        "enhanced_exposure_score": F.round(
            F.coalesce("rel_sum", F.lit(0.0)) + 0.35 * spill + 0.25 * wspill, 4
        ),
        "earnings_kw_pos_mentions": zero("pos_hits"),
        "earnings_kw_neg_mentions": zero("neg_hits"),
        "earnings_kw_pos_doc_count": zero("pos_docs"),
        "earnings_kw_neg_doc_count": zero("neg_docs"),
        "earnings_kw_polarity": F.round(
            F.when(
                mentions_total > 0, (zero("pos_hits") - zero("neg_hits")) / mentions_total
            ).otherwise(F.lit(0.0)),
            4,
        ),
        "earnings_kw_density": F.round(mentions_total / F.greatest(F.lit(1), n), 4),
    }
    return rows.select("symbol", "t_event", *[c.alias(name) for name, c in out.items()])


def top_drivers(
    events: DataFrame, named: DataFrame, entities: DataFrame, days: int = 7, k: int = 3
) -> DataFrame:
    """Titles of the ``k`` heaviest documents per event: polarity plus relevance.

    A day that lies whole in a window offers only its ``k`` heaviest documents
    of the alias, ranked once per (alias, day); single documents are read only
    on the two days that a window cuts.
    """
    alias_of = keyed_entities(entities).select("symbol", "alias")
    weight = F.greatest(F.abs("lex"), F.coalesce(F.abs("enc"), F.lit(0.0))) + F.col(
        "relevance_score"
    )
    weighed = named.where(F.col("headline") != "").select(
        "alias", "doc_id", "doc_ts", "headline", weight.alias("weight")
    )
    keyed = events.select("symbol", "t_event").distinct().join(alias_of, "symbol", "left")
    asked = keyed.where(F.col("alias").isNotNull()).select("alias", "t_event").distinct()
    order = [F.col("weight").desc(), F.col("doc_ts"), F.col("doc_id")]
    dated = weighed.withColumn("day", F.to_date("doc_ts"))
    start = F.col("t_event") - F.expr(f"INTERVAL {int(days)} DAYS")
    opens, closes = F.to_date(start), F.to_date("t_event")
    first_whole = F.when(start == F.date_trunc("day", start), opens).otherwise(F.date_add(opens, 1))
    last_whole = F.date_sub(closes, 1)
    ends = F.when(first_whole == opens, F.array(closes)).otherwise(
        F.array_distinct(F.array(opens, closes))
    )
    shown = ["alias", "t_event", "doc_id", "doc_ts", "headline", "weight"]
    whole = (
        asked.where(first_whole <= last_whole)
        .withColumn("day", F.explode(F.sequence(first_whole, last_whole)))
        .join(top_by(dated, ["alias", "day"], order, k).drop("rank"), ["alias", "day"])
        .select(*shown)
    )
    cut = (
        asked.withColumn("day", F.explode(ends))
        .join(dated, ["alias", "day"])
        .where(F.col("doc_ts").between(start, F.col("t_event")))
        .select(*shown)
    )
    ranked = top_by(whole.unionByName(cut), ["alias", "t_event"], order, k)
    listed = ranked.groupBy("alias", "t_event").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "headline"))), lambda s: s["headline"]
        ).alias("top_drivers")
    )
    return keyed.join(listed, ["alias", "t_event"], "left").select(
        "symbol",
        "t_event",
        F.coalesce("top_drivers", F.array().cast("array<string>")).alias("top_drivers"),
    )


def entities(symbols: DataFrame, company: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Terms by which each symbol is recognised: its ticker, and a name.

    The name is an override if given, else the company's, else the symbol.
    """
    clean = F.upper(F.trim("symbol"))
    base = symbols.select(clean.alias("symbol")).distinct().join(
        company.select("symbol", "name"), "symbol", "left"
    )
    if overrides is not None:
        base = base.join(overrides.select("symbol", F.col("name").alias("given")), "symbol", "left")
        name = F.coalesce("given", "name", "symbol")
    else:
        name = F.coalesce("name", "symbol")
    return base.select(
        "symbol", F.col("symbol").alias("ticker"), F.lower(F.trim(name)).alias("name")
    )
