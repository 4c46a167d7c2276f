"""Readers, writers, and payload parsing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.ctes import r
from tidemark.sources import articles as ar
from tidemark.sources import bars as br
from tidemark.sources import calendar as cl
from tidemark.sources import documents as ds
from tidemark.streaming.jobs import work_dir


@query(
    "document_scan",
    """SELECT doc_id, doc_ts, title, length(body) AS n_body, relevance_score FROM news""",
)
def document_scan(spark, sf):
    """Stored documents, read back from the partitioned table."""
    path = work_dir(spark, "documents")
    docs = v.news(spark, sf).select(
        "doc_id", "url", "published_at", "fetched_at", "source",
        F.lit(None).cast("string").alias("source_url"), "source_domain", "title", "body",
        F.array().cast("array<string>").alias("keyword_hits"), "relevance_score",
        F.lit("all").alias("query"),
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "fetched_at")})
    ds.write_documents(docs, path, "overwrite")
    return ds.in_time_order(ds.read_documents(spark, path)).select(
        "doc_id",
        F.col("doc_ts").cast("timestamp_ntz").alias("doc_ts"),
        "title",
        F.length("body").alias("n_body"),
        "relevance_score",
    )


@query("snapshot_roundtrip", "SELECT doc_id, doc_ts, title, md5(body) AS body_md5 FROM news")
def snapshot_roundtrip(spark, sf):
    path = work_dir(spark, "snapshot")
    docs = v.news(spark, sf).select("doc_id", "doc_ts", "title", "body")
    ds.write_snapshot(docs, path)
    return ds.read_snapshot(spark, path, docs.schema).select(
        "doc_id", "doc_ts", "title", F.md5(F.col("body").cast("binary")).alias("body_md5")
    )


def _stamp(col: str = "doc_ts"):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query(
    "ticker_payloads",
    f"""SELECT url, 'S' || lpad(CAST(CAST(doc_id AS BIGINT) % (SELECT count(*) FROM supplier) AS VARCHAR), 8, '0')
          AS symbol, title, md5(body) AS content_md5, doc_ts AS published_at, 'MARKETS' AS tags,
          {r('CAST(doc_id AS BIGINT) % 21 / 10.0 - 1.0')} AS polarity
        FROM news""",
)
def ticker_payloads(spark, sf):
    rows = v.ticker_articles(spark, sf)
    payload = F.to_json(
        F.array(
            F.struct(
                "title",
                F.when(F.pmod(F.col("doc_id").cast("bigint"), F.lit(2)) == 0, F.col("url")).alias("link"),
                F.col("url"),
                "content",
                _stamp("published_at").alias("date"),
                "source",
                F.array(F.lit("MARKETS")).alias("tags"),
                F.struct("polarity").alias("sentiment"),
            )
        )
    )
    parsed = ar.parse_ticker_articles(rows.select("symbol", payload.alias("value")))
    return parsed.select(
        "url",
        "symbol",
        F.trim(F.regexp_replace("title", "\n$", "")).alias("title"),
        F.md5(F.col("content").cast("binary")).alias("content_md5"),
        "published_at",
        F.array_join("tags", ",").alias("tags"),
        F.round("polarity", 6).alias("polarity"),
    )


@query("search_payloads", "SELECT url, doc_ts AS published_at, source, md5(body) AS content_md5 FROM news")
def search_payloads(spark, sf):
    rows = v.articles(spark, sf)
    article = F.struct(
        "title",
        "url",
        "description",
        "content",
        _stamp("published_at").alias("publishedAt"),
        F.struct(F.col("source").alias("name"), F.lit("").alias("url")).alias("source"),
    )
    payloads = rows.select(F.to_json(F.struct(F.array(article).alias("articles"))).alias("value"))
    return ar.parse_search_articles(payloads).select(
        "url", "published_at", "source", F.md5(F.col("content").cast("binary")).alias("content_md5")
    )


@query(
    "event_payloads",
    """SELECT url, CASE WHEN CAST(doc_id AS BIGINT) % 5 = 0 THEN NULL ELSE doc_ts END AS published_at,
         source, trim(regexp_replace(title || ' growth', '[\\s\\p{Z}]+', ' ', 'g')) AS description
       FROM news""",
)
def event_payloads(spark, sf):
    number = F.pmod(F.col("doc_id").cast("bigint"), F.lit(5))
    seen = (
        F.when(number == 0, F.lit("soon"))
        .when(number == 1, _stamp())
        .otherwise(F.date_format("doc_ts", "yyyyMMddHHmmss"))
    )
    article = F.struct("title", "url", seen.alias("seendate"), F.col("source").alias("domain"))
    payloads = v.news(spark, sf).select(
        F.to_json(F.struct(F.array(article).alias("articles"))).alias("value")
    )
    return ar.parse_event_articles(payloads, F.lit("growth")).select(
        "url", "published_at", "source", "description"
    )


def _escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


_COMPACT_TITLE = "trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g'))"


@query(
    "feed_articles",
    f"""SELECT url, {_COMPACT_TITLE} AS title, doc_ts AS published_at,
          CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 'rss.example.com' ELSE 'atom.example.com' END AS source
        FROM news WHERE doc_ts >= TIMESTAMP '1996-01-01 00:00:00'""",
)
def feed_articles(spark, sf):
    """One feed per document: RSS for even numbers, Atom for odd ones."""
    even = F.pmod(F.col("doc_id").cast("bigint"), F.lit(2)) == 0
    title = _escaped(F.col("title"))
    rss = F.concat(
        F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>x</title><item><title>'),
        title,
        F.lit("</title><link>"),
        F.col("url"),
        F.lit("</link><content:encoded><![CDATA[<p>a & b</p>]]></content:encoded><pubDate>"),
        F.date_format("doc_ts", "E, d MMM yyyy HH:mm:ss 'GMT'"),
        F.lit("</pubDate></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>x</title><entry><title>'),
        title,
        F.lit('</title><link rel="self" href="'),
        F.col("url"),
        F.lit('"/><updated>'),
        _stamp(),
        F.lit("</updated></entry></feed>"),
    )
    feeds = v.news(spark, sf).select(
        F.when(even, rss).otherwise(atom).alias("xml"),
        F.when(even, "https://rss.example.com/f").otherwise("https://www.atom.example.com/f").alias("feed_url"),
    )
    return ar.parse_feeds(feeds, since="1996-01-01").select("url", "title", "published_at", "source")


def _bar_payload(spark, sf):
    """Bars as text fields; every seventh bar has no usable close."""
    number = F.pmod(F.dayofyear("d"), F.lit(7))
    return v.bars(spark, sf).select(
        "symbol",
        F.date_format("d", "yyyy-MM-dd").alias("date"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low")],
        F.lit("1").alias("close"),
        F.when(number == 0, "NA").otherwise(F.col("close").cast("string")).alias("adjusted_close"),
    )


@query(
    "bar_payloads",
    "SELECT symbol, d, open, high, low, close FROM bars WHERE dayofyear(d) % 7 <> 0",
)
def bar_payloads(spark, sf):
    path = work_dir(spark, "bars")
    _bar_payload(spark, sf).write.mode("overwrite").json(path)
    return br.read_bars(spark, path)


def _hourly(spark, sf):
    return (
        v.ticks(spark, sf)
        .groupBy("symbol", F.date_trunc("hour", "ts").alias("h"))
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
        )
    )


_HOURLY = """
    SELECT symbol, date_trunc('hour', ts) AS ts, min_by(price, ts) AS open, max(price) AS high,
      min(price) AS low, max_by(price, ts) AS close FROM ticks GROUP BY symbol, date_trunc('hour', ts)"""


@query(
    "intraday_payloads",
    f"""SELECT * FROM ({_HOURLY})
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 450""",
)
def intraday_payloads(spark, sf):
    even = F.pmod(F.hour("h"), F.lit(2)) == 0
    raw = _hourly(spark, sf).select(
        "symbol",
        F.when(even, F.date_format("h", "yyyy-MM-dd HH:mm:ss")).alias("datetime"),
        F.when(~even, F.unix_timestamp(F.col("h").cast("timestamp")).cast("string")).alias("timestamp"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
    )
    return br.clean_intraday(raw)


@query(
    "calendar_payloads",
    f"""SELECT symbol, t_event FROM earnings
        WHERE t_event >= TIMESTAMP '{v.AS_OF} 00:00:00' - INTERVAL 1095 DAYS
          AND t_event < TIMESTAMP '{v.AS_OF} 00:00:00'
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t_event DESC) <= 24""",
)
def calendar_payloads(spark, sf):
    text = F.date_format("t_event", "yyyy-MM-dd")
    even = F.pmod(F.dayofyear("t_event"), F.lit(2)) == 0
    raw = v.earnings(spark, sf).select(
        F.concat(F.lower("symbol"), F.lit(".US")).alias("code"),
        F.when(even, text).alias("date"),
        F.when(~even, text).alias("report_date"),
    )
    # The same rows a second time: provider pages overlap.
    calendar = cl.calendar_rows(raw.unionByName(raw))
    return cl.past_earnings(calendar, v.AS_OF, 1095, 24)


@query(
    "coming_events",
    f"""SELECT symbol, min(t_event) AS t_event FROM earnings
        WHERE t_event BETWEEN TIMESTAMP '{v.AS_OF} 00:00:00' AND TIMESTAMP '{v.AS_OF} 00:00:00' + INTERVAL 14 DAYS
        GROUP BY symbol""",
)
def coming_events(spark, sf):
    return cl.upcoming_earnings(v.earnings(spark, sf), v.AS_OF, 14)


@query(
    "event_files",
    "SELECT * EXCLUDE (idx) FROM ev",
)
def event_files(spark, sf):
    """Event rows written into one result object per symbol, and read back."""
    from catalog.q_market import labelled

    events = labelled(spark, sf)
    row = F.struct(*events.columns)
    files = events.groupBy("symbol").agg(
        F.to_json(
            F.struct(
                F.lit("header").alias("mode"),
                F.collect_list(row).alias("events"),
            ),
            {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"},
        ).alias("value")
    )
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in events.schema)
    return ds.parse_events(files, fields)


@query(
    "result_roundtrip",
    "SELECT symbol, count(*) AS events, round(avg(actual_5d_return_pct), 4) AS mean_return FROM ev GROUP BY symbol",
)
def result_roundtrip(spark, sf):
    from catalog.q_market import labelled

    result = labelled(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg("actual_5d_return_pct"), 4).alias("mean_return")
    )
    path = work_dir(spark, "result")
    ds.write_result(result, path)
    return spark.read.schema(result.schema).json(path)


@query(
    "universe",
    """SELECT symbol, name, sector, source FROM (
         SELECT symbol, name, sector, source, tier, place FROM (
           SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS symbol, n_name AS name,
             'R' || CAST(n_regionkey AS VARCHAR) AS sector, 'core' AS source, 0 AS tier, n_nationkey AS place
           FROM nation
           UNION ALL
           SELECT code, name, 'Other AI', 'catalog', 1, place FROM (
             SELECT upper(CASE WHEN p_partkey % 40 = 0 THEN 'n' || CAST(p_partkey // 40 AS VARCHAR)
                          ELSE 'p' || CAST(p_partkey AS VARCHAR) END) AS code,
               p_name AS name, CASE WHEN p_size % 10 = 0 THEN 'ETF' ELSE 'Common Stock' END AS type,
               p_partkey AS place FROM part)
           WHERE length(code) <= 6 AND type = 'Common Stock')
         QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY tier, place) = 1
         ORDER BY tier, place, symbol LIMIT 1500)""",
)
def universe(spark, sf):
    core = v.table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("sector"),
        F.col("n_nationkey").cast("bigint").alias("place"),
    )
    key = F.col("p_partkey")
    code = F.when(
        F.pmod(key, F.lit(40)) == 0, F.concat(F.lit("n"), F.floor(key / 40).cast("string"))
    ).otherwise(F.concat(F.lit("p"), key.cast("string")))
    catalog = v.table(spark, sf, "part").select(
        code.alias("Code"),
        F.col("p_name").alias("Name"),
        F.when(F.pmod("p_size", F.lit(10)) == 0, "ETF").otherwise("Common Stock").alias("Type"),
        key.alias("place"),
    )
    return cl.resolve_universe(core, catalog, 1500)


@query(
    "bar_history",
    f"""SELECT d, open, close FROM bars
        WHERE symbol = 'S00000007'
          AND d BETWEEN DATE '{v.AS_OF}' - {2 * 366 + 45} AND DATE '{v.AS_OF}' + 1""",
)
def bar_history(spark, sf):
    rows = br.history(v.bars(spark, sf), "s00000007 ", v.AS_OF, "1d", years=2)
    return rows.select("d", "open", "close")


@query(
    "bar_points",
    f"""SELECT symbol, strftime(ts AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')
          AS t_utc, close FROM ({_HOURLY})
        UNION ALL SELECT symbol, strftime(d, '%Y-%m-%d'), close FROM tick_bars""",
)
def bar_points(spark, sf):
    hourly = _hourly(spark, sf).withColumn("ts", F.col("h").cast("timestamp_ntz"))
    intraday = br.intraday_points(hourly, zone="America/New_York")
    daily = br.daily_points(v.tick_bars(spark, sf))
    return intraday.unionByName(daily).select("symbol", "t_utc", "close")


@query(
    "market_points",
    """SELECT c.symbol, q.price, q.price - q.prev AS change,
          (q.price - q.prev) / q.prev * 100.0 AS change_percent,
          CASE WHEN q.price IS NULL THEN 'missing' ELSE 'quote' END AS source,
          coalesce(n.near, '') AS impacted
        FROM company c LEFT JOIN (
          SELECT symbol, price, prev FROM (
            SELECT symbol, d, close AS price, lag(close) OVER (PARTITION BY symbol ORDER BY d) AS prev
            FROM bars)
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1) q
          ON q.symbol = c.symbol AND CAST(substr(c.symbol, 2) AS BIGINT) % 10 <> 3
        LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS near FROM edges GROUP BY src) n
          ON n.src = c.symbol""",
)
def market_points(spark, sf):
    prev = F.lag("close").over(_by_symbol())
    last = (
        v.bars(spark, sf)
        .select("symbol", "d", "close", prev.alias("prev"), F.lead("d").over(_by_symbol()).alias("later"))
        .where(F.col("later").isNull())
    )
    quotes = last.where(F.pmod(F.substring("symbol", 2, 20).cast("bigint"), F.lit(10)) != 3).select(
        F.concat("symbol", F.lit(".US")).alias("code"),
        F.col("close").cast("string").alias("close"),
        F.col("prev").cast("string").alias("previousClose"),
        F.lit(None).cast("string").alias("change"),
        F.lit("NA").alias("change_p"),
        F.unix_timestamp(F.col("d").cast("timestamp")).cast("string").alias("timestamp"),
    )
    points = br.market_points(quotes, v.company(spark, sf), v.edges(spark, sf))
    return points.select(
        "symbol",
        "price",
        "change",
        "change_percent",
        "source",
        F.array_join("impacted_symbols", ",").alias("impacted"),
    )


def _by_symbol():
    return Window.partitionBy("symbol").orderBy("d")
