"""Landed bar payloads, history ranges, serialised points and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark import schema
from tidemark.core import top_by
from tidemark.functions import text as tx


def clean_bars(raw: DataFrame) -> DataFrame:
    """Daily bars from text fields; rows with a bad date or number drop out.

    The adjusted close is used if the payload has that column at all.
    """
    close = "adjusted_close" if "adjusted_close" in raw.columns else "close"
    typed = raw.select(
        "symbol",
        F.to_date(F.try_to_timestamp(F.substring("date", 1, 10))).alias("d"),
        *[
            F.col(src).try_cast("double").alias(name)
            for name, src in (("open", "open"), ("high", "high"), ("low", "low"), ("close", close))
        ],
    )
    return typed.dropna(subset=["d", "open", "high", "low", "close"])


def read_bars(spark, path: str) -> DataFrame:
    """Landed JSON-lines bar files; the files decide whether closes are adjusted."""
    raw = spark.read.schema(schema.DAILY_BAR).json(path)
    has_adjusted = raw.where(F.col("adjusted_close").isNotNull()).limit(1).count() > 0
    return clean_bars(raw if has_adjusted else raw.drop("adjusted_close"))


def clean_intraday(raw: DataFrame, most: int = fx.MAX_INTRADAY_BARS) -> DataFrame:
    """Intraday bars in UTC, the newest ``most`` per symbol.

    Time comes from ISO text, else from Unix seconds.
    """
    at = F.coalesce(
        tx.parse_ts(F.col("datetime")),
        F.timestamp_seconds(F.col("timestamp").try_cast("bigint")),
    )
    typed = raw.select(
        "symbol",
        at.cast("timestamp_ntz").alias("ts"),
        *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")],
    ).dropna(subset=["ts", "open", "high", "low", "close"])
    return top_by(typed, ["symbol"], [F.col("ts").desc()], most).drop("rank")


def read_intraday(spark, path: str, most: int = fx.MAX_INTRADAY_BARS) -> DataFrame:
    return clean_intraday(spark.read.schema(schema.INTRADAY_BAR).json(path), most)


def history_days(interval: str = "1d", days: int | None = None, years: float | None = None) -> int:
    """Calendar days a history request reaches back, clamped per interval."""
    default, most = fx.HISTORY_YEARS.get(interval, fx.HISTORY_YEARS["1d"])
    if years is not None:
        wanted = int(max(0.25, years) * 366)
    elif days is not None:
        wanted = max(30, days)
    else:
        wanted = default * 366
    buffer = 45 if interval == "1d" else 14
    return max(30, min(wanted, most * 366)) + buffer


def history(bars: DataFrame, symbol: str, as_of: str, interval: str = "1d",
            days: int | None = None, years: float | None = None) -> DataFrame:
    """Bars of one symbol in the requested range, oldest first."""
    day = F.lit(as_of).cast("date")
    reach = history_days(interval, days, years)
    return bars.where(
        (F.col("symbol") == symbol.strip().upper())
        & F.col("d").between(F.date_sub(day, reach), F.date_add(day, 1))
    ).orderBy("d")


def daily_points(bars: DataFrame) -> DataFrame:
    """Daily bars with the calendar date as text."""
    return bars.select(
        "symbol", F.date_format("d", "yyyy-MM-dd").alias("t_utc"), "open", "high", "low", "close"
    )


def intraday_points(bars: DataFrame, zone: str | None = None) -> DataFrame:
    """Intraday bars with UTC text times; ``zone`` names the zone of local times."""
    at = F.col("ts")
    if zone is not None:
        at = F.convert_timezone(F.lit(zone), F.lit("UTC"), at)
    return bars.select(
        "symbol",
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t_utc"),
        "open",
        "high",
        "low",
        "close",
    )


def market_points(quotes: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per symbol with price, change and the neighbours it touches.

    A symbol without a quote keeps a row of nulls.
    """
    code = F.upper(F.trim("code"))
    num = {c: F.col(c).try_cast("double") for c in ("close", "previousClose", "change", "change_p")}
    typed = quotes.where(F.col("code").isNotNull() & ~code.isin("", "NA")).select(
        F.regexp_replace(code, r"\..*$", "").alias("symbol"),
        num["close"].alias("price"),
        num["previousClose"].alias("previous_close"),
        F.coalesce(num["change"], num["close"] - num["previousClose"]).alias("change"),
        num["change_p"].alias("given_pct"),
        F.timestamp_seconds(F.col("timestamp").try_cast("bigint")).cast("timestamp_ntz").alias("as_of"),
    )
    near = edges.groupBy(F.col("src").alias("symbol")).agg(
        F.array_sort(F.collect_set("dst")).alias("impacted_symbols")
    )
    pct = F.when(F.col("previous_close") != 0, F.col("change") / F.col("previous_close") * 100.0)
    return (
        symbols.select("symbol")
        .join(typed, "symbol", "left")
        .join(near, "symbol", "left")
        .select(
            "symbol",
            "price",
            "previous_close",
            "change",
            F.coalesce("given_pct", pct).alias("change_percent"),
            "as_of",
            F.when(F.col("price").isNotNull(), F.lit("quote")).otherwise(F.lit("missing")).alias("source"),
            F.coalesce("impacted_symbols", F.array().cast("array<string>")).alias("impacted_symbols"),
        )
    )
