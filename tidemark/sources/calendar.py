"""Earnings calendars and the symbol universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark import schema
from tidemark.core import top_by
from tidemark.functions import text as tx

OTHER_SECTOR = "Other AI"


def symbol_of_code(code: Column) -> Column:
    """Symbol of a provider code: upper case, exchange suffix removed."""
    return F.substring_index(F.upper(F.trim(code)), ".", 1)


def calendar_rows(raw: DataFrame) -> DataFrame:
    """(symbol, t_event) of payload rows; the report date stands in for the date."""
    at = tx.parse_ts(F.coalesce(F.nullif("date", F.lit("")), "report_date")).cast("timestamp_ntz")
    return (
        raw.select(symbol_of_code(F.col("code")).alias("symbol"), at.alias("t_event"))
        .where((F.col("symbol") != "") & F.col("t_event").isNotNull())
        .distinct()
    )


def past_earnings(calendar: DataFrame, as_of: str, recent_days: int = 1095, limit: int = 24) -> DataFrame:
    """Events of the last ``recent_days`` before ``as_of``, newest ``limit`` per symbol."""
    now = F.lit(as_of).cast("timestamp_ntz")
    since = now - F.expr(f"INTERVAL {max(30, int(recent_days))} DAYS")
    recent = calendar.where((F.col("t_event") >= since) & (F.col("t_event") < now))
    return top_by(
        recent.select("symbol", "t_event").distinct(),
        ["symbol"],
        [F.col("t_event").desc()],
        max(1, limit),
    ).drop("rank")


def read_earnings(spark, path: str, as_of: str, recent_days: int = 1095, limit: int = 24) -> DataFrame:
    raw = spark.read.schema(schema.CALENDAR_ROW).json(path)
    return past_earnings(calendar_rows(raw), as_of, recent_days, limit)


def upcoming_earnings(calendar: DataFrame, as_of: str, horizon_days: int = 14) -> DataFrame:
    """Next event per symbol in ``[as_of, as_of + horizon]``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    until = now + F.expr(f"INTERVAL {max(1, int(horizon_days))} DAYS")
    return (
        calendar.where(F.col("t_event").between(now, until))
        .groupBy("symbol")
        .agg(F.min("t_event").alias("t_event"))
    )


def resolve_universe(
    core: DataFrame, catalog: DataFrame, cap: int = 500, longest: int = 6
) -> DataFrame:
    """Core companies first, then catalog symbols, up to ``cap`` (10 to 5000).

    ``core`` holds (symbol, name, sector, place); ``catalog`` holds (Code, Name,
    Type, place). Catalog rows must be common stock, short, and not core.
    """
    cap = max(10, min(cap, 5000))
    code = F.upper(F.trim("Code"))
    kind = F.lower(F.trim(F.coalesce("Type", F.lit(""))))
    first = core.select(
        "symbol", "name", "sector", F.lit("core").alias("source"), F.lit(0).alias("tier"), "place"
    )
    listed = catalog.where(
        (F.coalesce(code, F.lit("")) != "") & (F.length(code) <= longest) & kind.isin("", "common stock")
    ).select(
        code.alias("symbol"),
        F.coalesce(F.nullif(F.trim("Name"), F.lit("")), code).alias("name"),
        F.lit(OTHER_SECTOR).alias("sector"),
        F.lit("catalog").alias("source"),
        F.lit(1).alias("tier"),
        "place",
    )
    best = F.min_by(F.struct("name", "sector", "source", "tier", "place"), F.struct("tier", "place"))
    return (
        first.unionByName(listed)
        .groupBy("symbol")
        .agg(best.alias("u"))
        .select("symbol", "u.*")
        .orderBy("tier", "place", "symbol")
        .limit(cap)
        .drop("tier", "place")
    )


def default_companies(spark) -> DataFrame:
    """The built-in company list, in order."""
    rows = [(s, n, x, i) for i, (s, n, x) in enumerate(fx.COMPANIES)]
    return spark.createDataFrame(rows, "symbol string, name string, sector string, place int")


def default_edges(spark) -> DataFrame:
    """The built-in graph: neighbours (``is_peer``, with their ``place``) and weighted pairs.

    The weight is null where none is given; a pair may have a weight without
    being a neighbour.
    """
    weights = {(s, d): w for s, listed in fx.EDGE_WEIGHTS.items() for d, w in listed}
    places = {(s, d): i for s, listed in fx.NEIGHBOURS.items() for i, d in enumerate(listed)}
    rows = [
        (s, d, weights.get((s, d)), (s, d) in places, places.get((s, d)))
        for s, d in sorted(places.keys() | weights.keys())
    ]
    return spark.createDataFrame(
        rows, "src string, dst string, weight double, is_peer boolean, place int"
    )


def default_hedges(spark) -> DataFrame:
    rows = [(sector, listed[0]) for sector, listed in fx.SECTOR_HEDGES.items()]
    return spark.createDataFrame(rows, "sector string, hedge string")


def default_cap_weights(spark) -> DataFrame:
    return spark.createDataFrame(list(fx.CAP_WEIGHTS.items()), "symbol string, weight double")
