"""Document cleaning, gating, scoring, mentions and listings."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.ctes import occurrences, phrase_hits, r, whole_word
from tidemark import fixed_values as fx
from tidemark.functions import text as tx
from tidemark.functions import urls
from tidemark.functions.signals import event_key
from tidemark.operators import documents as dc

_SPACE = r"'[\s\p{Z}]+'"


@query(
    "compacted_texts",
    f"""SELECT conv_id, turn, md5(trim(regexp_replace(text, {_SPACE}, ' ', 'g'))) AS text_md5
        FROM conversations""",
)
def compacted_texts(spark, sf):
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(tx.compact_text(F.col("text")).cast("binary")).alias("text_md5")
    )


@query(
    "canonical_urls",
    "SELECT page_id, url, domain, substr(sha256(url), 1, 24) AS doc_id FROM clean_urls",
)
def canonical_urls(spark, sf):
    clean = v.raw_urls(spark, sf).select("page_id", urls.canonical_url(F.col("raw_url")).alias("url"))
    return clean.select(
        "page_id", "url", urls.domain(F.col("url")).alias("domain"), urls.doc_id(F.col("url")).alias("doc_id")
    )


TRUSTED = ("example.org", "therou.example.com", "tiontion.example.com")


@query(
    "trusted_pages",
    f"""SELECT page_id, domain FROM clean_urls WHERE EXISTS (
          SELECT 1 FROM (VALUES {", ".join(f"('{t}')" for t in TRUSTED)}) t(trusted)
          WHERE domain = trusted OR ends_with(domain, '.' || trusted))""",
)
def trusted_pages(spark, sf):
    pages = v.raw_urls(spark, sf).select(
        "page_id", urls.domain(urls.canonical_url(F.col("raw_url"))).alias("domain")
    )
    trusted = spark.createDataFrame([(t,) for t in TRUSTED], "domain string")
    return dc.filter_trusted(pages, trusted, "domain")


def _matched(terms, text: str) -> str:
    listed = ", ".join(
        "CASE WHEN " + whole_word(text, "'" + t.replace(" ", r"\s+") + "'") + f" THEN '{t}' END"
        for t in terms
    )
    return f"list_filter([{listed}], lambda x: x IS NOT NULL)"


@query(
    "matched_terms",
    f"""SELECT doc_id, array_to_string({_matched(v.AI_TERMS, 'lower(text)')}, ',') AS terms
        FROM documents""",
)
def matched_terms(spark, sf):
    hits = tx.match_terms(F.col("text"), v.AI_TERMS)
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(hits, ",").alias("terms"))


GATED = f"""
    SELECT doc_id, ctitle, body, ai, market,
           round(len(ai) * 2.0 + len(market) * 1.5, 2) AS relevance_score, url
    FROM (SELECT *, {_matched(v.AI_TERMS, "lower(ctitle || ' ' || body)")} AS ai,
                 {_matched(v.MARKET_TERMS, "lower(ctitle || ' ' || body)")} AS market
          FROM (SELECT doc_id, url, ctitle, source || ' reports ' || cbody AS body
                FROM compact_news))"""


@query(
    "relevance_gate",
    f"""SELECT substr(sha256(url), 1, 24) AS doc_id, url, md5(body) AS body_md5,
          CAST(relevance_score AS DOUBLE) AS relevance_score,
          array_to_string(list_sort(list_distinct(list_concat(ai, market))), ',') AS hits
        FROM ({GATED}) WHERE len(ai) > 0 AND len(market) > 0 AND relevance_score >= 3.5""",
)
def relevance_gate(spark, sf):
    docs = dc.relevance_gate(v.articles(spark, sf), v.AI_TERMS, v.MARKET_TERMS)
    return docs.select(
        "doc_id",
        "url",
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
        "relevance_score",
        F.array_join("keyword_hits", ",").alias("hits"),
    )


_TICKER_GATE = f"""
    SELECT substr(sha256(url), 1, 24) AS doc_id, sym,
      array_to_string(list_sort(list_distinct(list_concat(list_concat(ai, market), marks))), ',') AS hits,
      CAST(round(5.0 + abs(polarity) * 5.0 + greatest(0.0, lex), 2) AS DOUBLE) AS relevance_score,
      contains(low, lower(sym)) OR contains(low, name) OR
        len(list_filter(marks, lambda m: contains(upper(m), sym))) > 0 AS context, ai, market
    FROM (
      SELECT *, {_matched(v.AI_TERMS, "low")} AS ai, {_matched(v.MARKET_TERMS, "low")} AS market,
        CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS lex
      FROM (
        SELECT *, {occurrences('low', v.POSITIVE)} AS p, {occurrences('low', v.NEGATIVE)} AS n
        FROM (
          SELECT c.url, s.symbol AS sym, lower(s.name) AS name,
            lower(ctitle || ' ' || CASE WHEN cbody = '' THEN ctitle ELSE cbody END) AS low,
            CAST(c.doc_id AS BIGINT) % 21 / 10.0 - 1.0 AS polarity,
            CASE WHEN CAST(c.doc_id AS BIGINT) % 3 = 0 THEN list_sort(['MARKETS', s.symbol])
                 ELSE ['MARKETS'] END AS marks
          FROM compact_news c JOIN company s
            ON s.symbol = 'S' || lpad(CAST(CAST(c.doc_id AS BIGINT) % (SELECT count(*) FROM supplier)
                                           AS VARCHAR), 8, '0'))))"""


@query(
    "ticker_gate",
    f"""SELECT doc_id, sym AS symbol, hits, relevance_score FROM ({_TICKER_GATE})
        WHERE context OR ((len(ai) > 0 OR len(market) > 0) AND relevance_score >= 3.0)""",
)
def ticker_gate(spark, sf):
    docs = dc.ticker_relevance_gate(
        v.ticker_articles(spark, sf),
        v.company(spark, sf),
        v.AI_TERMS,
        v.MARKET_TERMS,
        v.POSITIVE,
        v.NEGATIVE,
    )
    return docs.select(
        "doc_id",
        F.replace("query", F.lit("ticker:"), F.lit("")).alias("symbol"),
        F.array_join("keyword_hits", ",").alias("hits"),
        "relevance_score",
    )


@query(
    "parsed_times",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL
         ELSE epoch(o_orderdate) + (o_orderkey % 86400) END AS BIGINT) AS epoch_s FROM orders""",
)
def parsed_times(spark, sf):
    key = F.col("o_orderkey")
    at = F.timestamp_seconds(
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.pmod(key, F.lit(86400))
    )
    kind = F.pmod(key, F.lit(5))
    raw = (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(
            kind == 1,
            F.concat(
                F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
                F.lit("+02:00"),
            ),
        )
        .when(kind == 2, F.date_format(at, "E, d MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == 3, F.date_format(at, "E, d MMM yyyy HH:mm:ss '+0000'"))
        .otherwise(F.lit("some day"))
    )
    return v.table(spark, sf, "orders").select(
        "o_orderkey", F.unix_timestamp(tx.parse_ts(raw)).alias("epoch_s")
    )


@query(
    "event_keys",
    """SELECT upper(trim(' ' || lower(symbol) || ' ')) AS symbol, date_trunc('second',
         t_event + INTERVAL 250 MILLISECONDS) AS t_event FROM earnings""",
)
def event_keys(spark, sf):
    messy = v.earnings(spark, sf).select(
        F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("symbol"),
        (F.col("t_event") + F.expr("INTERVAL 0.25 SECONDS")).alias("t_event"),
    )
    symbol, at = event_key(F.col("symbol"), F.col("t_event"))
    return messy.select(symbol.alias("symbol"), at.cast("timestamp_ntz").alias("t_event"))


_LABEL = "CASE WHEN lex > 0.05 THEN 'positive' WHEN lex < -0.05 THEN 'negative' ELSE 'neutral' END"


@query("lexicon_scores", f"SELECT doc_id, {r('lex')} AS score, {_LABEL} AS label FROM doc_facts")
def lexicon_scores(spark, sf):
    scored = dc.lexicon_scorer(v.POSITIVE, v.NEGATIVE)(v.news(spark, sf))
    return scored.withColumn("score", F.round("score", 6))


def _stored_scores(spark, sf):
    """Scores an earlier run has left: the labelled documents, by two models."""
    models = F.explode(F.array(F.lit(fx.LEXICON_MODEL), F.lit("encoder-v1")))
    return v.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        models.alias("model_name"),
        F.col("quality").cast("double").alias("score"),
        F.lit("old").alias("label"),
        F.lit("2001-01-01").alias("scored_at"),
    )


def _top_up(spark, sf):
    return dc.ensure_scores(
        v.news(spark, sf),
        _stored_scores(spark, sf),
        fx.LEXICON_MODEL,
        dc.lexicon_scorer(v.POSITIVE, v.NEGATIVE),
        "2001-06-30",
    )


@query(
    "score_top_up",
    f"""SELECT doc_id, 'lexicon-v1' AS model_name, {r('lex')} AS score, {_LABEL} AS label,
          '2001-06-30' AS scored_at
        FROM doc_facts WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
)
def score_top_up(spark, sf):
    return _top_up(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "score_upsert",
    f"""SELECT model_name, label, count(*) AS n FROM (
          SELECT 'lexicon-v1' AS model_name, {_LABEL} AS label FROM doc_facts
            WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
          UNION ALL SELECT m, 'old' FROM labels, (VALUES ('lexicon-v1'), ('encoder-v1')) t(m))
        GROUP BY model_name, label""",
)
def score_upsert(spark, sf):
    merged = dc.upsert_scores(_stored_scores(spark, sf), _top_up(spark, sf))
    return merged.groupBy("model_name", "label").agg(F.count(F.lit(1)).alias("n"))


def _load_classifier():
    """Stand-in for a text model: class odds from two word counts."""
    import numpy as np

    def predict(texts):
        out = []
        for text in texts:
            low = str(text).lower()
            odds = np.array([1 + low.count("thing"), 1 + low.count("oning"), 2.0])
            out.append(odds / odds.sum())
        return np.asarray(out, dtype="float32")

    return predict


@query(
    "model_scores",
    """SELECT doc_id, round(CAST((p - n) / (p + n + 2.0) AS DOUBLE), 4) AS score,
         CASE WHEN p >= n AND p >= 2 THEN 'positive' WHEN n >= 2 THEN 'negative'
              ELSE 'neutral' END AS label
       FROM (SELECT doc_id, 1 + (length(low) - length(replace(low, 'thing', ''))) // 5 AS p,
                    1 + (length(low) - length(replace(low, 'oning', ''))) // 5 AS n
             FROM (SELECT doc_id, lower(title || ' ' || body) AS low FROM news))""",
)
def model_scores(spark, sf):
    scored = dc.model_scorer(_load_classifier)(v.news(spark, sf))
    return scored.withColumn("score", F.round("score", 4))


@query(
    "documents_with_scores",
    f"""SELECT n.doc_id, CAST(l.quality AS DOUBLE) AS score FROM news n
        LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = n.doc_id""",
)
def documents_with_scores(spark, sf):
    return dc.scores_for(
        v.news(spark, sf).select("doc_id"), _stored_scores(spark, sf), "encoder-v1"
    )


def _present(low: str, terms) -> str:
    return " + ".join(f"CAST(contains({low}, '{t}') AS INTEGER)" for t in terms)


TANH_AI = ("thatin", "of the", "ertion")


@query(
    "tanh_sentiment",
    f"""SELECT doc_id, ai_hits, round(tanh((pos - neg + 0.35 * ai_hits) / 4.5), 6) AS score
        FROM (SELECT doc_id, {_present('low', v.POSITIVE)} AS pos,
                {_present('low', v.NEGATIVE)} AS neg, {_present('low', TANH_AI)} AS ai_hits
              FROM (SELECT doc_id,
                      trim(regexp_replace(lower(title || ' ' || body), {_SPACE}, ' ', 'g')) AS low
                    FROM news))""",
)
def tanh_sentiment(spark, sf):
    score, hits = tx.tanh_sentiment(F.col("title"), F.col("body"), v.POSITIVE, v.NEGATIVE, TANH_AI)
    return v.news(spark, sf).select("doc_id", hits.alias("ai_hits"), score.alias("score"))


@query(
    "phrase_hits",
    f"""SELECT doc_id, {phrase_hits('text', v.GOOD_PHRASES)} AS good,
          {phrase_hits('text', v.BAD_PHRASES)} AS bad FROM documents""",
)
def phrase_hits_query(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id",
        tx.pattern_hits(F.col("text"), v.GOOD_PHRASES).alias("good"),
        tx.pattern_hits(F.col("text"), v.BAD_PHRASES).alias("bad"),
    )


def aliases(spark, sf):
    return (
        v.entities(spark, sf)
        .select(F.concat_ws("|", "ticker", "name").alias("alias"), "ticker", "name")
        .distinct()
    )


@query("document_mentions", "SELECT doc_id, alias, by_ticker FROM named")
def document_mentions(spark, sf):
    return dc.mentions(v.news(spark, sf), aliases(spark, sf))


_HARD_TERMS = (
    ("five", "anea. Eriner", "the and attion to thanedble"),
    ("comma", "the. The", "the, anea"),
    ("edge", "Nowhere&Co", "thanea."),
)


@query(
    "punctuated_mentions",
    "SELECT doc_id, alias, max(by_ticker) AS by_ticker FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{alias}' AS alias, {k} AS by_ticker FROM news WHERE "
        + whole_word(text, "'" + term.replace(".", r"\.") + "'")
        for alias, ticker, name in _HARD_TERMS
        for k, text, term in (
            (1, "(title || ' ' || body)", ticker),
            (0, "lower(title || ' ' || body)", name),
        )
    )
    + ") GROUP BY doc_id, alias",
)
def punctuated_mentions(spark, sf):
    """Names of five words, with a comma, ending in a full stop; tickers with dots and signs."""
    terms = spark.createDataFrame(list(_HARD_TERMS), "alias string, ticker string, name string")
    return dc.mentions(v.news(spark, sf), terms)


def _announcing(spark, sf):
    """News whose body ends with the date of an earnings call 3 weeks ahead."""
    on = F.date_format(F.date_add(F.to_date("doc_ts"), 21), "MMMM d, yyyy")
    return v.news(spark, sf).withColumn(
        "body", F.concat("body", F.lit(" Earnings call on "), on, F.lit("."))
    )


@query(
    "announced_dates",
    f"""SELECT alias, event_date, url, event_date + INTERVAL '13:30' HOUR TO MINUTE AS t_event FROM (
          SELECT m.alias, CAST(n.doc_ts AS DATE) + 21 AS event_date, n.url
          FROM named m JOIN news n ON n.doc_id = m.doc_id
          WHERE CAST(n.doc_ts AS DATE) + 21 BETWEEN DATE '{v.AS_OF}' AND DATE '{v.AS_OF}' + 60
          QUALIFY row_number() OVER (PARTITION BY m.alias ORDER BY n.doc_ts DESC, n.doc_id DESC) = 1)""".replace(
        "event_date + INTERVAL '13:30' HOUR TO MINUTE",
        "CAST(event_date AS TIMESTAMP) + INTERVAL 13 HOURS + INTERVAL 30 MINUTES",
    ),
)
def announced_dates(spark, sf):
    return dc.extract_earnings_dates(_announcing(spark, sf), aliases(spark, sf), v.AS_OF)


@query(
    "corpus_stats",
    f"""SELECT count(*) AS total,
          count(*) FILTER (doc_ts >= TIMESTAMP '{v.AS_OF} 00:00:00' - INTERVAL 7 DAYS) AS last_7_days,
          min(doc_ts) AS first_ts, max(doc_ts) AS last_ts FROM news""",
)
def corpus_stats(spark, sf):
    return dc.corpus_stats(v.news(spark, sf), v.AS_OF)


@query(
    "top_domains",
    """SELECT source_domain, count(*) AS documents FROM news GROUP BY source_domain
       ORDER BY documents DESC, source_domain LIMIT 15""",
)
def top_domains(spark, sf):
    return dc.top_domains(v.news(spark, sf))


@query(
    "latest_documents",
    "SELECT doc_id, doc_ts, title FROM news ORDER BY doc_ts DESC, doc_id LIMIT 50",
)
def latest_documents(spark, sf):
    docs = v.news(spark, sf).select("doc_id", "doc_ts", "title")
    return dc.latest(docs, [F.col("doc_ts").desc(), F.col("doc_id")], 50, most=250)


def _sources(spark, sf):
    """The same news from three sources: tickers, search, and feeds."""
    base = v.articles(spark, sf).drop("priority")
    doc = F.col("doc_id").cast("bigint")
    return {
        "ticker_news": v.ticker_articles(spark, sf).drop("priority").where(F.pmod(doc, F.lit(4)) == 0),
        "search_news": base.where(F.pmod(doc, F.lit(4)) < 2),
        "feed": base.withColumn("url", F.concat("url", F.lit("?utm_medium=rss"))),
    }


@query(
    "source_counts",
    """SELECT 'ticker_news' AS transport, count(*) AS articles FROM documents WHERE doc_id % 4 = 0
       UNION ALL SELECT 'search_news', count(*) FROM documents WHERE doc_id % 4 < 2
       UNION ALL SELECT 'feed', count(*) FROM documents""",
)
def source_counts(spark, sf):
    return dc.source_counts(dc.union_sources(_sources(spark, sf)))


@query(
    "deduped_documents",
    """SELECT url, CASE WHEN CAST(doc_id AS BIGINT) % 4 = 0 THEN 0
         WHEN CAST(doc_id AS BIGINT) % 4 = 1 THEN 1 ELSE 3 END AS priority
       FROM news WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
)
def deduped_documents(spark, sf):
    found = dc.union_sources(_sources(spark, sf)).withColumn(
        "url", urls.canonical_url(F.col("url"))
    )
    toxic = v.table(spark, sf, "labels").where(F.col("toxic") == 1)
    stored = v.news(spark, sf).join(
        toxic.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi"
    )
    kept = dc.dedupe_documents(
        found.select("url", "priority", "published_at", "title"), stored
    )
    return kept.select("url", "priority")
