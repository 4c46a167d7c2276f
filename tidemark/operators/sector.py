"""Sector outlook from document scores, return correlation and the graph.

No document is paired with every company. A document's score for a symbol is its
sector base, plus 1 where it mentions the symbol, so the sums over all documents
come from per-sector totals corrected by the mentions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core.sides import small_side
from tidemark.functions import text as tx
from tidemark.functions.signals import clamp, direction, sign_dz
from tidemark.operators.market import daily_returns
from tidemark.session import cut_lineage


def sector_doc_scores(
    docs: DataFrame,
    keywords: Mapping[str, Sequence[str]] = fx.SECTOR_KEYWORDS,
    positive: Sequence[str] = fx.SECTOR_POSITIVE,
    negative: Sequence[str] = fx.SECTOR_NEGATIVE,
) -> DataFrame:
    """Per document and sector: 1.2 x sector keywords present + sentiment."""
    low = F.lower(tx.headline_and_body(F.col("title"), F.col("body")))
    scored = docs.withColumns(
        {
            "__sentiment": tx.terms_present(low, positive) - tx.terms_present(low, negative),
            "__bases": F.array(
                *[
                    F.struct(
                        F.lit(sector).alias("sector"), tx.terms_present(low, terms).alias("hits")
                    )
                    for sector, terms in keywords.items()
                ]
            ),
        }
    )
    return scored.select("doc_id", "doc_ts", "__sentiment", F.explode("__bases").alias("b")).select(
        "doc_id",
        "doc_ts",
        F.col("b.sector").alias("sector"),
        (1.2 * F.col("b.hits") + F.col("__sentiment")).alias("base"),
    )


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters of a text."""
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    )


def substring_mentions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term) for each term that occurs in the lower-cased text at all.

    ``terms`` has a column ``term``; empty terms occur nowhere. A term is looked
    up by its anchor, the trigram that is rarest in these documents (a shorter
    term is its own). A document gives its distinct trigrams to the lookup; those
    that terms have are stored, counted, and meet the anchors by equality; the
    texts of documents that hold an anchor are then searched for its terms. So
    neither the plan nor the work per document grows with the number of terms.

    The sizes of the anchors (1 to 3) come to the driver.
    """
    low = F.lower(tx.headline_and_body(F.col("title"), F.col("body")))
    size = F.least(F.lit(GRAM), F.char_length("low"))
    wanted = (
        terms.select("term", F.lower("term").alias("low")).distinct().where("low != ''")
        .withColumn("size", size)
    )
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]
    own = F.lit(None).cast("array<string>")
    for k in sizes:
        own = F.when(F.col("size") == k, _grams(F.col("low"), k)).otherwise(own)
    parts = wanted.select("term", F.explode(own).alias("gram"))
    grams = [_grams(low, k) for k in sizes] or [F.array().cast("array<string>")]
    found = cut_lineage(
        docs.select("doc_id", F.explode(F.concat(*grams)).alias("gram")).join(
            small_side(parts.select("gram").distinct()), "gram"
        )
    )
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = (
        parts.join(counts, "gram", "left")
        .groupBy("term")
        .agg(
            F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"),
            F.min(F.coalesce("n", F.lit(0))).alias("n"),
        )
        .where("n > 0")
        .select("term", "gram")
    )
    pairs = cut_lineage(found.join(small_side(anchors), "gram").select("doc_id", "term"))
    held = pairs.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    return (
        docs.select("doc_id", "doc_ts", low.alias("__low"))
        .join(small_side(held, counted=pairs), "doc_id")
        .select(
            "doc_id",
            "doc_ts",
            F.explode(F.filter("terms", lambda t: F.contains("__low", F.lower(t)))).alias("term"),
        )
    )


def term_sets(company_terms: DataFrame) -> DataFrame:
    """(symbol, alias): symbols with the same terms share one alias."""
    return company_terms.groupBy("symbol").agg(
        F.array_join(F.array_sort(F.collect_set("term")), "|").alias("alias")
    )


def alias_mentions(docs: DataFrame, company_terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (doc_id, alias): the text holds one of the alias's terms.

    ``company_terms`` maps symbol to term. Documents never meet single symbols,
    only distinct sets of terms.
    """
    of_alias = company_terms.join(aliases, "symbol").select("alias", "term").distinct()
    return (
        substring_mentions(docs, of_alias)
        .select("doc_id", "term")
        .join(of_alias, "term")
        .select("doc_id", "alias")
        .distinct()
    )


def _score_means(
    bases: DataFrame, named: DataFrame, members: DataFrame, as_of: Column
) -> DataFrame:
    """Per symbol: mean score of 5 years, mean non-zero score and mentions of 7 days.

    ``members`` holds symbol, alias and sector; sums over mentions are made once
    per (alias, sector).
    """
    in_5y = F.col("doc_ts") >= as_of - F.expr("INTERVAL 1825 DAYS")
    in_7d = F.col("doc_ts") >= as_of - F.expr("INTERVAL 7 DAYS")
    recent = bases.where(in_5y & (F.col("doc_ts") <= as_of)).withColumn("recent", in_7d)
    live = F.col("recent") & (F.col("base") != 0)
    totals = recent.groupBy("sector").agg(
        F.sum("base").alias("sum_5y"),
        F.count(F.lit(1)).alias("n_5y"),
        F.sum(F.when(F.col("recent"), F.col("base")).otherwise(0.0)).alias("sum_7d"),
        F.count_if(live).alias("live_7d"),
    )
    lifted = F.col("recent") & (F.col("base") + 1.0 != 0)
    fixes = (
        named.join(members.select("alias", "sector").distinct(), "alias")
        .join(recent.select("doc_id", "sector", "base", "recent"), ["doc_id", "sector"])
        .groupBy("alias", "sector")
        .agg(
            F.count(F.lit(1)).alias("named_5y"),
            F.count_if("recent").alias("named_7d"),
            (F.count_if(lifted) - F.count_if(live)).alias("live_change"),
        )
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("named_5y", "named_7d", "live_change")}
    rows = members.join(totals, "sector", "left").join(fixes, ["alias", "sector"], "left").withColumns(zero)
    live_n = F.col("live_7d") + F.col("live_change")
    return rows.select(
        "symbol",
        "sector",
        F.when(F.col("n_5y") > 0, (F.col("sum_5y") + F.col("named_5y")) / F.col("n_5y"))
        .otherwise(F.lit(0.0))
        .alias("history"),
        F.when(live_n > 0, (F.col("sum_7d") + F.col("named_7d")) / live_n)
        .otherwise(F.lit(0.0))
        .alias("pressure"),
        F.col("named_7d").alias("mentions_7d"),
    )


def sector_correlation(bars: DataFrame, company: DataFrame, members: DataFrame,
                       lookback: int = 252) -> DataFrame:
    """Correlation of a symbol's last returns with its sector's mean return by date.

    ``members`` assigns each symbol the sector to compare with; the symbol's own
    return is left out of the mean.
    """
    rets = daily_returns(bars)
    pool = (
        rets.join(company.select("symbol", "sector"), "symbol")
        .groupBy("sector", "d")
        .agg(F.sum("return_pct").alias("total"), F.count(F.lit(1)).alias("n"))
    )
    home = company.select("symbol", F.col("sector").alias("home"))
    newest = Window.partitionBy("symbol").orderBy(F.col("d").desc())
    own = (F.col("home") == F.col("sector")).cast("int")
    peers = F.col("n") - own
    mean = (F.col("total") - own * F.col("return_pct")) / peers
    aligned = (
        rets.withColumn("age", F.row_number().over(newest))
        .where(F.col("age") <= lookback)
        .join(members, "symbol")
        .join(home, "symbol")
        .join(pool, ["sector", "d"])
        .select("symbol", "return_pct", F.when(peers > 0, mean).alias("peer_return"))
    )
    moves = (F.col("sx") > 0) & (F.col("sy") > 0)
    return (
        aligned.where(F.col("peer_return").isNotNull())
        .groupBy("symbol")
        .agg(
            F.stddev_samp("return_pct").alias("sx"),
            F.stddev_samp("peer_return").alias("sy"),
            F.corr("return_pct", "peer_return").alias("c"),
        )
        .select("symbol", F.when(moves, F.col("c")).otherwise(F.lit(0.0)).alias("correlation"))
    )


def symbol_outlook(
    docs: DataFrame,
    bars: DataFrame,
    company: DataFrame,
    company_terms: DataFrame,
    edges: DataFrame,
    as_of: str,
    sector: str | None = None,
    keywords: Mapping[str, Sequence[str]] = fx.SECTOR_KEYWORDS,
    positive: Sequence[str] = fx.SECTOR_POSITIVE,
    negative: Sequence[str] = fx.SECTOR_NEGATIVE,
) -> DataFrame:
    """Predicted move of every symbol, in one sector's or in its own context.

    ``connected_to`` is the first-listed neighbour (``place`` of ``edges``), else
    the first company of the sector (``place`` of ``company``). Edges with
    ``is_peer`` false are no neighbours.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    upto = bars.where(F.col("d") <= F.lit(as_of).cast("date"))
    members = company.select(
        "symbol", (F.col("sector") if sector is None else F.lit(sector)).alias("sector")
    )
    aliases = term_sets(company_terms)
    bases = sector_doc_scores(docs, keywords, positive, negative)
    named = alias_mentions(docs, company_terms, aliases)
    means = _score_means(bases, named, members.join(aliases, "symbol", "left"), at)
    corr = sector_correlation(upto, company, members)
    last = upto.groupBy("symbol").agg(F.max_by("close", "d").alias("current_price"))
    peers = edges.where("is_peer") if "is_peer" in edges.columns else edges
    listed = F.col("place") if "place" in edges.columns else F.lit(None).cast("int")
    degree = peers.groupBy(F.col("src").alias("symbol")).agg(
        F.count(F.lit(1)).alias("neighbours"),
        F.min_by("dst", F.struct(listed.isNull(), listed, "dst")).alias("nearest"),
    )
    rank = F.col("place") if "place" in company.columns else F.lit(None).cast("int")
    leader = company.groupBy("sector").agg(
        F.min_by("symbol", F.struct(rank.isNull(), rank, "symbol")).alias("leader")
    )
    rows = (
        means.join(corr, "symbol", "left")
        .join(last, "symbol", "left")
        .join(degree, "symbol", "left")
        .join(leader, "sector", "left")
        .withColumn("connected_to", F.coalesce("nearest", "leader"))
        .withColumns(
            {
                "correlation": F.coalesce("correlation", F.lit(0.0)),
                "neighbours": F.coalesce("neighbours", F.lit(0)),
            }
        )
    )
    move = clamp(
        0.45 * F.col("pressure") + 0.35 * F.col("history") + 1.1 * F.col("correlation"),
        -12.0,
        12.0,
    )
    return rows.withColumn("move", move).select(
        "symbol",
        "sector",
        "current_price",
        "move",
        F.round("move", 2).alias("predicted_move_pct"),
        direction(sign_dz(F.col("move"), fx.SECTOR_DEAD_ZONE), "move").alias("predicted_direction"),
        F.when(F.col("move") >= 0, F.lit("Leverage")).otherwise(F.lit("Hedge")).alias(
            "leverage_or_hedge"
        ),
        F.round("correlation", 3).alias("correlation_to_sector"),
        "neighbours",
        "connected_to",
        "mentions_7d",
    )


def strongest_first() -> list[Column]:
    return [F.abs("predicted_move_pct").desc(), F.col("symbol")]


def _top(outlook: DataFrame, n: int) -> DataFrame:
    return outlook.orderBy(*strongest_first()).limit(n)


def sector_summary(outlook: DataFrame, bars: DataFrame, company: DataFrame, sector: str,
                   as_of: str) -> DataFrame:
    """One row: the sector's move and confidence from its five strongest symbols."""
    five = _top(outlook, 5).agg(
        F.round(F.sum(F.abs("predicted_move_pct")) / 5.0, 2).alias("metric_a"),
        F.round(F.sum(F.abs("correlation_to_sector")) / 5.0, 3).alias("metric_b"),
        F.round(F.sum(F.greatest(F.lit(0.0), F.col("predicted_move_pct"))) / 5.0, 2).alias("metric_c"),
        F.round(F.sum("neighbours") / 5.0, 2).alias("metric_d"),
    )
    hits = outlook.agg(F.sum("mentions_7d")).scalar()
    upto = bars.where(F.col("d") <= F.lit(as_of).cast("date"))
    in_sector = company.where(F.col("sector") == sector).select("symbol")
    mean = (
        daily_returns(upto)
        .join(in_sector, "symbol", "left_semi")
        .agg(F.coalesce(F.avg("return_pct"), F.lit(0.0)))
        .scalar()
    )
    move = clamp(0.55 * F.col("metric_a") + 2.0 * mean + 0.75 * F.col("metric_b"), -12.0, 12.0)
    confidence = clamp(
        30.0 + F.least(F.lit(40), hits) * 1.1 + F.col("metric_b") * 20.0, 5.0, 95.0
    )
    return five.withColumns(
        {
            "sector": F.lit(sector),
            "predicted_sector_move_pct": F.round(move, 2),
            "confidence": F.round(confidence, 1),
            "news_articles_7d": hits,
        }
    )


def sector_picks(outlook: DataFrame, owned: DataFrame, n_owned: int = 3, n_other: int = 5) -> DataFrame:
    """The strongest owned and the strongest other symbols."""
    mine = outlook.join(owned.select("symbol").distinct(), "symbol", "left_semi")
    other = outlook.join(owned.select("symbol").distinct(), "symbol", "left_anti")
    return (
        _top(mine, n_owned)
        .withColumn("owned", F.lit(True))
        .unionByName(_top(other, n_other).withColumn("owned", F.lit(False)))
    )


def universe_summary(outlook: DataFrame) -> DataFrame:
    """Mean move per sector, strongest first."""
    return (
        outlook.groupBy("sector")
        .agg(
            F.round(F.avg("move"), 2).alias("predicted_move_pct"),
            F.count(F.lit(1)).alias("stock_count"),
        )
        .orderBy(F.abs("predicted_move_pct").desc(), "sector")
    )


def universe_confidence(outlook: DataFrame) -> DataFrame:
    five = _top(outlook, 5).agg(F.avg(F.abs("correlation_to_sector")).alias("c"))
    hits = outlook.agg(F.sum("mentions_7d")).scalar()
    value = clamp(30.0 + F.least(F.lit(40), hits) * 1.1 + F.col("c") * 20.0, 5.0, 95.0)
    return five.select(F.round(value, 1).alias("confidence"), hits.alias("news_articles_7d"))
