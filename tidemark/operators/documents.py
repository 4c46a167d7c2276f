"""Document ingest, gating, scoring and listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core.sides import small_side
from tidemark.functions import text as tx
from tidemark.functions import urls
from tidemark.session import cut_lineage


def event_time(df: DataFrame) -> DataFrame:
    """Documents with a usable time, missing text as '' and score as number."""
    at = F.coalesce(F.col("published_at"), F.col("fetched_at"))
    return df.withColumns(
        {
            "doc_ts": at,
            "title": F.coalesce("title", F.lit("")),
            "body": F.coalesce("body", F.lit("")),
            "relevance_score": F.coalesce(F.col("relevance_score").cast("double"), F.lit(0.0)),
        }
    ).where(F.col("doc_ts").isNotNull())


def filter_trusted(df: DataFrame, trusted: DataFrame, domain: str = "source_domain") -> DataFrame:
    """Rows whose domain equals, or lies under, a trusted domain.

    Distinct domains are spread into their parent domains and matched by
    equality, so the cost does not grow with the number of trusted domains.
    """
    good = (
        df.select(domain)
        .where(F.col(domain) != "")
        .distinct()
        .withColumn("trusted", F.explode(urls.domain_suffixes(F.col(domain))))
        .join(trusted.select(F.col("domain").alias("trusted")), "trusted", "left_semi")
        .select(domain)
        .distinct()
    )
    return df.join(good, domain, "left_semi")


def _with_link(articles: DataFrame) -> DataFrame:
    url = tx.compact_text(F.col("url"))
    return (
        articles.where(url != "")
        .withColumn("url", urls.canonical_url(url))
        .withColumn("source_domain", urls.domain(F.col("url")))
    )


def _document_columns(df: DataFrame) -> DataFrame:
    return df.select(
        urls.doc_id(F.col("url")).alias("doc_id"),
        "url",
        "published_at",
        "fetched_at",
        "source",
        "source_url",
        "source_domain",
        "title",
        "body",
        "keyword_hits",
        "relevance_score",
        "query",
        "priority",
    )


def _hits(df: DataFrame, ai_terms: Sequence[str], market_terms: Sequence[str]) -> DataFrame:
    combined = tx.joined_parts(F.col("title"), F.col("body"))
    return (
        df.withColumn("combined", combined)
        .where(F.col("combined") != "")
        .withColumns(
            {
                "ai_hits": tx.match_terms(F.col("combined"), ai_terms),
                "market_hits": tx.match_terms(F.col("combined"), market_terms),
            }
        )
    )


def relevance_gate(
    articles: DataFrame,
    ai_terms: Sequence[str] = fx.AI_CORE_TERMS,
    market_terms: Sequence[str] = fx.MARKET_IMPACT_TERMS,
    min_score: float = 3.5,
) -> DataFrame:
    """Web articles to documents; both term families must occur."""
    cleaned = _with_link(articles).withColumns(
        {
            "title": tx.compact_text(F.col("title")),
            "body": tx.joined_parts(
                tx.compact_text(F.col("description")), tx.compact_text(F.col("content"))
            ),
            "source": F.coalesce(
                F.nullif(tx.compact_text(F.col("source")), F.lit("")), F.lit("unknown")
            ),
        }
    )
    scored = _hits(cleaned, ai_terms, market_terms).where(
        (F.size("ai_hits") > 0) & (F.size("market_hits") > 0)
    )
    score = F.round(F.size("ai_hits") * 2.0 + F.size("market_hits") * 1.5, 2)
    hits = F.array_sort(F.array_union("ai_hits", "market_hits"))
    return _document_columns(
        scored.withColumns({"relevance_score": score, "keyword_hits": hits}).where(
            F.col("relevance_score") >= min_score
        )
    )


def ticker_relevance_gate(
    articles: DataFrame,
    company: DataFrame,
    ai_terms: Sequence[str] = fx.AI_CORE_TERMS,
    market_terms: Sequence[str] = fx.MARKET_IMPACT_TERMS,
    positive: Sequence[str] = fx.LEXICON_POSITIVE,
    negative: Sequence[str] = fx.LEXICON_NEGATIVE,
    min_score: float = 3.0,
) -> DataFrame:
    """Articles fetched for a ticker to documents; a ticker context always passes."""
    title, content = tx.compact_text(F.col("title")), tx.compact_text(F.col("content"))
    names = company.select(
        F.upper(F.trim("symbol")).alias("symbol"), F.lower("name").alias("company_name")
    )
    cleaned = (
        _with_link(articles)
        .withColumns(
            {
                "title": title,
                "body": F.coalesce(F.nullif(content, F.lit("")), title),
                "symbol": F.upper(F.trim("symbol")),
                "source": F.coalesce(
                    F.nullif(tx.compact_text(F.col("source")), F.lit("")), F.lit("ticker_news")
                ),
            }
        )
        .join(names, "symbol", "left")
        .withColumn("company_name", F.coalesce("company_name", F.lower("symbol")))
    )
    marks = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform(
                    F.concat(
                        F.coalesce("tags", F.array().cast("array<string>")),
                        F.coalesce("symbols", F.array().cast("array<string>")),
                    ),
                    lambda x: F.trim(x),
                ),
                lambda x: x != "",
            )
        )
    )
    scored = _hits(cleaned, ai_terms, market_terms).withColumn("marks", marks)
    low = F.lower("combined")
    context = (
        low.contains(F.lower("symbol"))
        | low.contains(F.col("company_name"))
        | F.exists("marks", lambda m: F.upper(m).contains(F.col("symbol")))
    )
    score = F.round(
        5.0
        + F.abs(F.coalesce(F.col("polarity").cast("double"), F.lit(0.0))) * 5.0
        + F.greatest(
            F.lit(0.0),
            tx.lexicon_score(
                tx.headline_and_body(F.col("title"), F.col("body")), positive, negative
            ),
        ),
        2,
    )
    return _document_columns(
        scored.withColumns({"context": context, "relevance_score": score})
        .where(
            F.col("context")
            | (
                ((F.size("ai_hits") > 0) | (F.size("market_hits") > 0))
                & (F.col("relevance_score") >= min_score)
            )
        )
        .withColumns(
            {
                "keyword_hits": F.array_sort(
                    F.array_union(F.array_union("ai_hits", "market_hits"), F.col("marks"))
                ),
                "source_url": F.col("url"),
                "query": F.concat(F.lit("ticker:"), F.col("symbol")),
            }
        )
    )


SOURCE_PRIORITY = ("ticker_news", "search_news", "event_news", "feed")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Articles of all sources, each with its place in the order of preference."""
    out = None
    for rank, name in enumerate(SOURCE_PRIORITY):
        if name not in sources:
            continue
        tagged = sources[name].withColumns(
            {"priority": F.lit(rank), "transport": F.lit(name)}
        )
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def source_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("transport").agg(F.count(F.lit(1)).alias("articles"))


def dedupe_documents(new: DataFrame, existing: DataFrame | None = None,
                     order: Sequence[str] = ("priority", "published_at", "title")) -> DataFrame:
    """First document per URL by source priority; URLs already stored drop out.

    Written as an aggregation, which reduces a heavily copied URL before the
    shuffle. ``order`` breaks ties among copies of one URL.
    """
    others = [c for c in new.columns if c != "url"]
    first = (
        new.groupBy("url")
        .agg(F.min_by(F.struct(*others), F.struct(*order)).alias("doc"))
        .select("url", "doc.*")
        .select(*new.columns)
    )
    if existing is None:
        return first
    return first.join(existing.select("url").distinct(), "url", "left_anti")


def ensure_scores(docs: DataFrame, scores: DataFrame, model: str, scorer, scored_at) -> DataFrame:
    """New score rows for the documents that ``model`` has not scored yet.

    ``scorer`` maps (doc_id, title, body) rows to (doc_id, score, label).
    """
    done = scores.where(F.col("model_name") == model).select("doc_id")
    todo = docs.select("doc_id", "title", "body").join(done, "doc_id", "left_anti")
    return scorer(todo).select(
        "doc_id",
        F.lit(model).alias("model_name"),
        F.col("score").cast("double").alias("score"),
        "label",
        F.lit(scored_at).alias("scored_at"),
    )


def upsert_scores(scores: DataFrame, new: DataFrame) -> DataFrame:
    """Latest score per (doc_id, model_name)."""
    merged = scores.unionByName(new)
    return (
        merged.groupBy("doc_id", "model_name")
        .agg(F.max_by(F.struct("score", "label", "scored_at"), "scored_at").alias("s"))
        .select("doc_id", "model_name", "s.*")
    )


def lexicon_scorer(positive: Sequence[str] = fx.LEXICON_POSITIVE,
                   negative: Sequence[str] = fx.LEXICON_NEGATIVE):
    """Scorer for ``ensure_scores`` that needs no model."""

    def score(docs: DataFrame) -> DataFrame:
        value = tx.lexicon_score(
            tx.headline_and_body(F.col("title"), F.col("body")), positive, negative
        )
        return docs.select("doc_id", value.alias("score")).withColumn(
            "label", tx.score_label(F.col("score"))
        )

    return score


def model_scorer(make_predict_fn, batch_size: int = 32):
    """Scorer for ``ensure_scores`` around a text classifier.

    ``make_predict_fn`` loads the model once per Python worker and returns a
    function from an array of texts to class probabilities ordered
    (positive, negative, neutral).
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    labels = F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral"))

    def score(docs: DataFrame) -> DataFrame:
        classify = predict_batch_udf(
            make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size
        )
        text = F.trim(tx.headline_and_body(F.col("title"), F.col("body")))
        probs = docs.select(
            "doc_id", classify(F.when(text == "", F.lit(" ")).otherwise(text)).alias("p")
        )
        top = F.array_position("p", F.array_max("p")).cast("int")
        return probs.select(
            "doc_id",
            (F.col("p")[0] - F.col("p")[1]).cast("double").alias("score"),
            F.element_at(labels, top).alias("label"),
        )

    return score


def scores_for(docs: DataFrame, scores: DataFrame, model: str, name: str = "score") -> DataFrame:
    """Documents with their score by ``model``; null where there is none."""
    picked = scores.where(F.col("model_name") == model).select(
        "doc_id", F.col("score").alias(name)
    )
    return docs.join(picked, "doc_id", "left")


def mention_terms(aliases: DataFrame) -> DataFrame:
    """Ticker and lower-cased name of each alias, with its distinct words; terms without a word go."""
    tickers = aliases.select("alias", F.col("ticker").alias("term"), F.lit(1).alias("by_ticker"))
    names = aliases.select("alias", F.lower("name").alias("term"), F.lit(0).alias("by_ticker"))
    return (
        tickers.unionByName(names)
        .distinct()
        .withColumn("words", tx.distinct_words(F.col("term")))
        .where(F.size("words") > 0)
    )


def term_words(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, word, by_ticker) where a document holds a word of the terms.

    A document is exploded into its distinct words once, as they are spelled:
    words of tickers meet them in that case, words of names in lower case.
    """
    vocabulary = (
        terms.select(F.explode("words").alias("word"), "by_ticker")
        .distinct()
        .withColumn("__low", F.lower("word"))
    )
    text = tx.headline_and_body(F.col("title"), F.col("body"))
    return (
        docs.select("doc_id", F.explode(tx.cased_words(text)).alias("__w"))
        .select("doc_id", F.col("__w.low").alias("__low"), "__w.lowered", F.col("__w.word").alias("__word"))
        .join(small_side(vocabulary), "__low")
        .where(
            F.when(F.col("by_ticker") == 1, F.col("word") == F.col("__word")).otherwise(F.col("lowered"))
        )
        .select("doc_id", "word", "by_ticker")
    )


def rarest_words(terms: DataFrame, found: DataFrame) -> DataFrame:
    """Each term with its anchor, the word that the fewest rows of ``found`` hold.

    A term with a word that no document holds is left out.
    """
    counts = found.groupBy("word", "by_ticker").agg(F.count(F.lit(1)).alias("n"))
    plain = (F.size("words") == 1) & (F.col("words")[0] == F.col("term"))
    return (
        terms.select("alias", "term", "by_ticker", plain.alias("plain"), F.explode("words").alias("word"))
        .join(counts, ["word", "by_ticker"], "left")
        .groupBy("alias", "term", "by_ticker", "plain")
        .agg(
            F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"),
            F.min(F.coalesce("n", F.lit(0))).alias("n"),
        )
        .where("n > 0")
        .drop("n")
    )


def mentions(docs: DataFrame, aliases: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct (doc_id, alias) pairs, with whether the ticker itself was found.

    ``aliases`` holds (alias, ticker, name): the ticker matches in its original
    case, the name in lower-cased text, and no word character may touch either.
    Each term is looked up by one word, its anchor: the one that is rarest in
    these documents. A document gives at most its distinct words to the lookup;
    the words that terms have are stored, counted, and meet the anchors by
    equality. That settles terms of a single word; all others (several words,
    punctuation) are searched in the texts of the documents that hold their
    anchor. So the cost does not grow with the number of companies.
    ``keep`` names columns of ``docs`` to add to the pairs.
    """
    terms = mention_terms(aliases)
    found = cut_lineage(term_words(docs, terms))
    held = found.join(small_side(rarest_words(terms, found)), ["word", "by_ticker"])
    text = tx.headline_and_body(F.col("title"), F.col("body"))
    read = F.when(F.col("by_ticker") == 1, F.col("__text")).otherwise(F.lower("__text"))
    unsure = held.where(~F.col("plain")).select("doc_id", "alias", "by_ticker", "term").distinct()
    searched = (
        docs.select("doc_id", text.alias("__text"))
        .join(small_side(unsure), "doc_id")
        .where(F.contains(read, F.col("term")))
        .where(F.regexp_like(read, tx.whole_term(F.col("term"))))
    )
    columns = ["doc_id", "alias", "by_ticker"]
    named = (
        held.where("plain")
        .select(*columns)
        .unionByName(searched.select(*columns))
        .groupBy("doc_id", "alias")
        .agg(F.max("by_ticker").alias("by_ticker"))
    )
    return named.join(docs.select("doc_id", *keep), "doc_id") if keep else named


def extract_earnings_dates(
    docs: DataFrame,
    aliases: DataFrame,
    as_of,
    horizon_days: int = 60,
    context: str = fx.CALL_CONTEXT,
    date_pattern: str = fx.CALL_DATE,
) -> DataFrame:
    """Next announced date per alias: first date in the newest document that
    mentions it next to an announcement phrase; the event is set at 13:30."""
    today = F.lit(as_of).cast("date")
    text = tx.headline_and_body(F.col("title"), F.col("body"))
    said = docs.where(text.rlike(context)).where(text.rlike(date_pattern))
    found = F.arrays_zip(
        *[
            F.regexp_extract_all(text, F.lit(date_pattern), F.lit(i)).alias(n)
            for i, n in ((1, "month"), (2, "day"), (3, "year"))
        ]
    )
    dated = said.select("doc_id", "doc_ts", "url", F.posexplode(found).alias("pos", "m")).select(
        "doc_id",
        "doc_ts",
        "url",
        "pos",
        F.try_to_timestamp(
            F.concat_ws(" ", F.initcap("m.month"), "m.day", "m.year"), F.lit("MMMM d yyyy")
        )
        .cast("date")
        .alias("on"),
    )
    first = (
        dated.where(F.col("on").between(today, F.date_add(today, horizon_days)))
        .groupBy("doc_id", "doc_ts", "url")
        .agg(F.min_by("on", "pos").alias("on"))
    )
    named = mentions(said, aliases).select("doc_id", "alias")
    newest = F.struct("doc_ts", "doc_id")
    return (
        first.join(named, "doc_id")
        .groupBy("alias")
        .agg(F.max_by(F.struct("on", "url"), newest).alias("e"))
        .select("alias", F.col("e.on").alias("event_date"), F.col("e.url").alias("url"))
        .withColumn(
            "t_event", F.col("event_date").cast("timestamp_ntz") + F.expr("INTERVAL '13:30' HOUR TO MINUTE")
        )
    )


def corpus_stats(docs: DataFrame, as_of) -> DataFrame:
    """Document count, count of the last 7 days, first and last date."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return docs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("doc_ts") >= since).alias("last_7_days"),
        F.min("doc_ts").alias("first_ts"),
        F.max("doc_ts").alias("last_ts"),
    )


def top_domains(docs: DataFrame, n: int = 15) -> DataFrame:
    return (
        docs.where(F.col("source_domain") != "")
        .groupBy("source_domain")
        .agg(F.count(F.lit(1)).alias("documents"))
        .orderBy(F.col("documents").desc(), "source_domain")
        .limit(n)
    )


def latest(df: DataFrame, order: Sequence[Column], n: int, most: int | None = None) -> DataFrame:
    """First ``n`` rows in ``order``, ``n`` held between 1 and ``most``."""
    n = max(1, n if most is None else min(n, most))
    return df.orderBy(*order).limit(n)

