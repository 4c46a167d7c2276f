"""The operators' inputs, bound to the given tables.

The tables hold no prices, earnings or news, so each input is derived from them
by a deterministic rule; every view grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import spread

TICKERS = ("thatin", "ononst", "thble", "thtion", "ertion", "eriner")
NAMES = ("of the", "and the", "is the", "thing", "erble")
POSITIVE = ("thing", "erble", "attion")
NEGATIVE = ("oning", "ering", "thanea")
GOOD_PHRASES = (r"ing +the", r"tion +(?:of|in|and)")
BAD_PHRASES = (r"er +(?:and|or)", r"ion +is")
AI_TERMS = ("the", "of the", "thatin", "thing", "ertion", "is")
MARKET_TERMS = ("and", "in the", "ononst", "thble", "for")
AS_OF = "2001-06-30"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def symbol_of(key) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 8, "0"))


def _cents(name: str) -> F.Column:
    return (F.col(name).cast("decimal(14,2)") * 100).cast("bigint")


def bars(spark, sf) -> DataFrame:
    """Daily bars per supplier: unit prices of the lines shipped that day."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("d"))
        .agg(
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            (
                F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("double")
                / F.sum(F.col("l_quantity").cast("bigint")).cast("double")
            ).alias("close"),
        )
        .select(
            symbol_of(F.col("l_suppkey")).alias("symbol"),
            "d",
            ((F.col("high") + F.col("low")) / 2).alias("open"),
            "high",
            "low",
            "close",
        )
    )


def index_bars(spark, sf) -> DataFrame:
    """One bar per day over all lines: the traded index."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("d"))
        .agg(
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            (
                F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("double")
                / F.sum(F.col("l_quantity").cast("bigint")).cast("double")
            ).alias("close"),
        )
        .select("d", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", "close")
    )


def earnings(spark, sf) -> DataFrame:
    """First shipment of each supplier and quarter, at midnight."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.trunc(F.to_date("l_shipdate"), "quarter").alias("q"))
        .agg(F.min("l_shipdate").alias("t_event"))
        .select(symbol_of(F.col("l_suppkey")).alias("symbol"), "t_event")
    )


def earnings_shifted(spark, sf) -> DataFrame:
    """The calendar a day and a half later: often no trading day, never midnight."""
    return earnings(spark, sf).select(
        "symbol", (F.col("t_event") + F.expr("INTERVAL 36 HOURS")).alias("t_event")
    )


def company(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(
        symbol_of(F.col("s_suppkey")).alias("symbol"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("sector"),
    )


def edges(spark, sf) -> DataFrame:
    """Each supplier points at the next one and the seventh after it."""
    keys = table(spark, sf, "supplier").select("s_suppkey")
    n = keys.agg(F.count(F.lit(1))).scalar()
    hops = F.explode(
        F.array(
            F.struct(F.lit(1).alias("hop"), F.lit(0.9).alias("weight")),
            F.struct(F.lit(7).alias("hop"), F.lit(0.6).alias("weight")),
        )
    )
    return (
        keys.select("s_suppkey", hops.alias("h"))
        .select(
            symbol_of(F.col("s_suppkey")).alias("src"),
            symbol_of(F.pmod(F.col("s_suppkey") + F.col("h.hop"), n)).alias("dst"),
            F.col("h.weight").alias("weight"),
            F.col("h.hop").alias("hop"),
        )
        .where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.max("weight").alias("weight"), F.min("hop").alias("place"))
    )


def graph(spark, sf) -> DataFrame:
    """The edges, and the fourth supplier on as a weight without being a peer."""
    near = edges(spark, sf).drop("place")
    keys = table(spark, sf, "supplier").select("s_suppkey")
    n = keys.agg(F.count(F.lit(1))).scalar()
    far = (
        keys.select(
            symbol_of(F.col("s_suppkey")).alias("src"),
            symbol_of(F.pmod(F.col("s_suppkey") + 4, n)).alias("dst"),
        )
        .where(F.col("src") != F.col("dst"))
        .join(near.select("src", "dst"), ["src", "dst"], "left_anti")
    )
    return near.withColumn("is_peer", F.lit(True)).unionByName(
        far.withColumns({"weight": F.lit(0.3), "is_peer": F.lit(False)})
    )


def hedges(spark, sf) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("sector"),
        F.col("r_name").alias("hedge"),
    )


def cap_weight(spark, sf) -> DataFrame:
    """Index weights: supplier balances, made positive, over their sum."""
    base = table(spark, sf, "supplier").select(
        symbol_of(F.col("s_suppkey")).alias("symbol"),
        (F.col("s_acctbal").cast("decimal(14,2)") + 2000).alias("size"),
    )
    total = base.agg(F.sum("size").cast("double")).scalar()
    return base.select("symbol", (F.col("size").cast("double") / total).alias("weight"))


def news(spark, sf) -> DataFrame:
    doc = F.col("doc_id")
    shift = F.make_interval(days=F.pmod(doc * 37, F.lit(2500)).cast("int"),
                            hours=F.pmod(doc, F.lit(24)).cast("int"))
    at = F.lit("1995-01-02 00:00:00").cast("timestamp_ntz") + shift
    return spread(table(spark, sf, "documents")).select(
        doc.cast("string").alias("doc_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/n/"), doc.cast("string")).alias("url"),
        at.alias("published_at"),
        at.alias("fetched_at"),
        at.alias("doc_ts"),
        F.col("source"),
        F.concat("source", F.lit(".example.com")).alias("source_domain"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        "lang",
        (F.pmod(doc, F.lit(50)) / 10.0).alias("relevance_score"),
    )


def entities(spark, sf) -> DataFrame:
    """Terms by which a supplier is mentioned: one of 6 words, one of 5 names."""
    key = F.col("s_suppkey")

    def nth(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]),
                            (F.pmod(key, F.lit(len(values))) + 1).cast("int"))

    return table(spark, sf, "supplier").select(
        symbol_of(key).alias("symbol"), nth(TICKERS).alias("ticker"), nth(NAMES).alias("name")
    )


def encoder_scores(spark, sf) -> DataFrame:
    """A model's scores, from the labelled documents."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        (F.col("quality") * 0.5 - F.col("toxic") * 0.75).alias("score"),
    )


def trades(spark, sf) -> DataFrame:
    """Orders as trades of five strategies."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("strategy"),
        F.col("o_orderdate").alias("t_event"),
        symbol_of(F.col("o_orderkey")).alias("symbol"),
        F.col("o_orderkey").alias("trade_key"),
        (F.pmod(_cents("o_totalprice"), F.lit(1000)) / 100.0 - 5).alias(
            "actual_5d_return_pct"
        ),
        (F.pmod(F.col("o_orderkey"), F.lit(100)) / 100.0).alias("conf"),
        F.when(F.col("o_orderstatus") == "F", 1)
        .when(F.col("o_orderstatus") == "O", -1)
        .otherwise(0)
        .alias("sign"),
    )


def ticks(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), "ts", F.col("value").alias("price")
    )


def tick_bars(spark, sf) -> DataFrame:
    """Daily open, high, low, close per user of the event stream."""
    return (
        ticks(spark, sf)
        .groupBy("symbol", F.to_date("ts").alias("d"))
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
        )
    )


def journal(spark, sf) -> DataFrame:
    """Orders as a trade journal: one account per customer."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "closed")
        .when(F.col("o_orderstatus") == "O", "open")
        .otherwise("planned")
    )
    pnl = F.pmod(_cents("o_totalprice"), F.lit(200000)) / 100.0 - 900
    return table(spark, sf, "orders").select(
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("account"),
        F.col("o_orderkey").alias("trade_id"),
        F.to_date("o_orderdate").alias("day"),
        status.alias("status"),
        pnl.alias("pnl_usd"),
    )


def raw_urls(spark, sf) -> DataFrame:
    """Page addresses, a third each as found, with tracking, and in upper case."""
    url, kind = F.col("url"), F.pmod("page_id", F.lit(3))
    bare = F.regexp_replace(url, "#.*$", "")
    tracked = F.concat(
        bare,
        F.when(bare.contains("?"), "&").otherwise("?"),
        F.lit("utm_source=a&q=&FBCLID=b&flag#frag"),
    )
    shouted = F.replace(
        F.replace(url, F.lit("https://"), F.lit("  HTTPS://WWW.")),
        F.lit("http://"),
        F.lit("Http://www."),
    )
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(kind == 0, url).when(kind == 1, tracked).otherwise(shouted).alias("raw_url"),
    )


def articles(spark, sf) -> DataFrame:
    """News documents in the shape of fetched web articles."""
    return news(spark, sf).select(
        "doc_id",
        "url",
        F.concat(F.lit("  "), "title", F.lit("\n")).alias("title"),
        F.concat("source", F.lit("  reports")).alias("description"),
        F.col("body").alias("content"),
        F.col("source"),
        F.lit(None).cast("string").alias("source_url"),
        F.col("published_at"),
        F.col("fetched_at"),
        F.lit("all").alias("query"),
        F.lit(1).alias("priority"),
    )


def ticker_articles(spark, sf) -> DataFrame:
    """News documents in the shape of articles fetched for one ticker each."""
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    doc = F.col("doc_id").cast("bigint")
    return articles(spark, sf).withColumns(
        {
            "symbol": symbol_of(F.pmod(doc, n)),
            "tags": F.array(F.lit(" MARKETS "), F.lit("")),
            "symbols": F.when(F.pmod(doc, F.lit(3)) == 0, F.array(symbol_of(F.pmod(doc, n)))),
            "polarity": F.pmod(doc, F.lit(21)) / 10.0 - 1.0,
        }
    )
