"""Features of daily bars and of events placed on them.

Windows run per symbol over daily bars; the calendar bounds their size however
many raw rows a symbol owns, since bars are aggregated per (symbol, day) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core import asof_join, interval_rollup
from tidemark.core.timelines import total_at
from tidemark.functions.signals import pct_change, sign_dz


def _by_date():
    return Window.partitionBy("symbol").orderBy("d")



def _back(bars_ago: int) -> Column:
    """Close ``bars_ago`` earlier, clamped at the first bar."""
    return F.coalesce(F.lag("close", bars_ago).over(_by_date()), F.first("close").over(_by_date().rowsBetween(Window.unboundedPreceding, 0)))


def bar_index() -> Column:
    return F.row_number().over(_by_date()) - 1


def daily_returns(bars: DataFrame) -> DataFrame:
    """Percent change to the previous close; no row where that is 0 or absent."""
    ret = pct_change(F.lag("close").over(_by_date()), F.col("close"))
    return (
        bars.select("symbol", "d", ret.alias("return_pct")).where(F.col("return_pct").isNotNull())
    )


def bar_features(bars: DataFrame) -> DataFrame:
    """Everything an event needs from its bar, from one window pass per symbol."""
    close = F.col("close")
    prev = F.lag("close").over(_by_date())
    ret = F.when(prev != 0, (close - prev) / prev)
    with_ret = bars.select("symbol", "d", "close", ret.alias("ret"), bar_index().alias("idx"))
    vol_30 = F.stddev_samp("ret").over(_by_date().rowsBetween(-30, -1)) * 100.0
    vol_60 = F.stddev_samp("ret").over(_by_date().rowsBetween(-58, 0)) * 100.0
    return with_ret.select(
        "symbol",
        "d",
        "idx",
        "close",
        pct_change(_back(7), _back(1)).alias("pre_7"),
        pct_change(_back(31), _back(1)).alias("pre_30"),
        pct_change(_back(61), _back(1)).alias("pre_60"),
        pct_change(_back(5), close).alias("last_5"),
        pct_change(close, F.lead("close", 5).over(_by_date())).alias("post_5"),
        F.when(F.col("idx") >= 6, vol_30).alias("vol_30"),
        F.when(F.col("idx") >= 4, vol_60).otherwise(F.lit(2.0)).alias("vol_60"),
    )


def baseline_events(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Label and momentum signal of each event; events without 5 later bars drop out."""
    placed = asof_join(events, bar_features(bars).select("symbol", "d", "idx", "pre_7", "post_5"))
    return placed.where(F.col("pre_7").isNotNull() & F.col("post_5").isNotNull()).select(
        "symbol",
        "t_event",
        F.round("post_5", 4).alias("actual_5d_return_pct"),
        sign_dz(F.col("post_5"), fx.LABEL_DEAD_ZONE).alias("actual_sign"),
        F.round("pre_7", 4).alias("baseline_pre_7d_return_pct"),
        sign_dz(F.col("pre_7"), fx.SIGNAL_DEAD_ZONE).alias("baseline_pred_sign"),
    )


def symbol_features(events: DataFrame, bars: DataFrame, strict: bool = False) -> DataFrame:
    """Momentum, volatility and the drift after the symbol's previous event.

    ``strict`` leaves out a drift that ends after the event's own bar. The
    previous event is found over distinct event dates, since events of one
    symbol on one date share their bar.
    """
    dated = events.withColumn("on", F.to_date("t_event"))
    dates = dated.groupBy("symbol", "on").agg(F.min("t_event").alias("first_t"))
    placed = asof_join(dates, bar_features(bars), event_ts="on")
    by_date = Window.partitionBy("symbol").orderBy("on")
    here, before = F.struct("idx", "post_5"), F.lag(F.struct("idx", "post_5")).over(by_date)
    dates = placed.select("*", here.alias("here"), before.alias("before"))
    prior = F.when(F.col("t_event") > F.col("first_t"), F.col("here")).otherwise(F.col("before"))
    rows = dated.join(dates, ["symbol", "on"]).withColumn("prior", prior)
    drift = F.col("prior.post_5")
    if strict:
        drift = F.when(F.col("prior.idx") + 5 <= F.col("idx"), drift)

    def out(value: Column) -> Column:
        return F.coalesce(F.round(value, 4), F.lit(0.0))

    return rows.select(
        "symbol",
        "t_event",
        out(F.col("pre_30")).alias("pre_30d_return_pct"),
        out(F.col("pre_60")).alias("pre_60d_return_pct"),
        out(F.col("vol_30")).alias("pre_30d_vol_pct"),
        out(drift).alias("prior_post_earnings_5d_return_pct"),
    )


def peer_counts(company: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct peers per symbol: companies of its sector, and neighbours elsewhere.

    A sector is kept as one group with a size; its pairs are never built.
    """
    members = company.select("symbol", "sector")
    sizes = members.groupBy("sector").agg(F.count(F.lit(1)).alias("size"))
    away = _neighbours_outside(edges, members).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("outside")
    )
    return (
        members.join(sizes, "sector")
        .join(away, "symbol", "left")
        .select(
            "symbol",
            (F.col("size") - 1).alias("sector_peers"),
            F.coalesce("outside", F.lit(0)).alias("outside_neighbours"),
            (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("peers"),
        )
    )


def _neighbours_outside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (symbol, dst) edges that leave the symbol's sector.

    Edges with ``is_peer`` false only weigh and are left out.
    """
    edges = edges.where("is_peer") if "is_peer" in edges.columns else edges
    there = members.select(F.col("symbol").alias("dst"), F.col("sector").alias("dst_sector"))
    return (
        edges.select(F.col("src").alias("symbol"), "dst")
        .distinct()
        .join(members, "symbol", "left")
        .join(there, "dst", "left")
        .where(~F.col("sector").eqNullSafe(F.col("dst_sector")) | F.col("sector").isNull())
        .select("symbol", "dst")
    )


def return_steps(features: DataFrame) -> DataFrame:
    """(``symbol``, ``on``, ``change``, ``count``): changes of the 5-bar return as of a date.

    ``features`` holds ``symbol``, ``d`` and ``last_5``; a null return counts as
    none. The first bar counts from the beginning of time; after the last bar
    there is none. Returns are taken to 12 decimals, so that sums are exact.
    """
    value = F.coalesce(F.round("last_5", 12).cast("decimal(30,12)"), F.lit(0).cast("decimal(30,12)"))
    valued = features.select(
        "symbol", "d", value.alias("v"), F.col("last_5").isNotNull().cast("int").alias("c")
    )
    before = {c: F.coalesce(F.lag(c).over(_by_date()), F.lit(0)) for c in ("v", "c")}
    first = F.lit("0001-01-01").cast("date")
    begin = F.struct(
        F.coalesce(F.date_add(F.lag("d").over(_by_date()), 1), first).alias("on"),
        (F.col("v") - before["v"]).cast("decimal(38,12)").alias("change"),
        (F.col("c") - before["c"]).alias("count"),
    )
    end = F.when(
        F.lead("d").over(_by_date()).isNull(),
        F.struct(
            F.date_add("d", 1).alias("on"),
            (-F.col("v")).cast("decimal(38,12)").alias("change"),
            (-F.col("c")).alias("count"),
        ),
    )
    return (
        valued.select("symbol", begin.alias("begin"), end.alias("end"))
        .select("symbol", F.explode(F.array_compact(F.array("begin", "end"))).alias("s"))
        .select("symbol", "s.*")
    )


def cohort_return(events: DataFrame, bars: DataFrame, company: DataFrame) -> DataFrame:
    """Mean 5-bar return of the event's sector peers, ending on or after its date.

    A symbol's return as of a date is a step function of the date: from the day
    after one bar to the next bar it is that bar's. Each symbol adds its steps
    to its sector as exact decimals; the sector's running totals are read at the
    event dates, less the event's own symbol. So no event or date meets the
    members of a sector, and a sector's window has a row per date.
    """
    members = company.select("symbol", "sector")
    features = bar_features(bars).select("symbol", "d", "last_5")
    dated = events.withColumn("on", F.to_date("t_event"))
    asked = dated.select("symbol", "on").distinct().join(members, "symbol")
    by_sector = Window.partitionBy("sector").orderBy("on", "asked")
    upto = by_sector.rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        return_steps(features)
        .join(members, "symbol")
        .groupBy("sector", "on")
        .agg(F.sum("change").alias("change"), F.sum("count").alias("count"))
    )
    sector = (
        steps.withColumn("asked", F.lit(0))
        .unionByName(
            asked.select("sector", "on").distinct().withColumn("asked", F.lit(1)),
            allowMissingColumns=True,
        )
        .withColumns({"total": F.sum("change").over(upto), "n": F.sum("count").over(upto)})
        .where("asked = 1 AND n > 0")
        .select("sector", "on", F.col("total").cast("double").alias("total"), "n")
    )
    own = asof_join(
        dated.select("symbol", "on").distinct(), features, event_ts="on"
    ).select("symbol", "on", F.col("last_5").alias("own"))
    rows = (
        dated.join(members, "symbol", "left")
        .join(sector, ["sector", "on"], "left")
        .join(own, ["symbol", "on"], "left")
    )
    peers = F.col("n") - F.col("own").isNotNull().cast("int")
    mean = (F.col("total") - F.coalesce("own", F.lit(0.0))) / peers
    return rows.select(
        "symbol",
        "t_event",
        F.coalesce(F.when(peers > 0, F.round(mean, 4)), F.lit(0.0)).alias(
            "sector_cohort_5d_return_pct"
        ),
    )


def _covered_spans(calendar: DataFrame, days: int) -> DataFrame:
    """Start (+1) and end (-1) of the disjoint spans in which a symbol has had an
    event within the last ``days``; built from first and last event per day."""
    reach = F.expr(f"INTERVAL {int(days)} DAYS")
    daily = calendar.groupBy("symbol", F.to_date("t_event").alias("day")).agg(
        F.min("t_event").alias("lo"), F.max("t_event").alias("hi")
    )
    by_day = Window.partitionBy("symbol").orderBy("day")
    opens = F.col("lo") > F.lag("hi").over(by_day) + reach
    closes = F.lead("lo").over(by_day) > F.col("hi") + reach
    marked = daily.withColumns(
        {"opens": F.coalesce(opens, F.lit(True)), "closes": F.coalesce(closes, F.lit(True))}
    )
    starts = marked.where("opens").select(
        "symbol", F.col("lo").alias("t_event"), F.lit(1).alias("change"), F.lit(0).alias("rank")
    )
    ends = marked.where("closes").select(
        "symbol",
        (F.col("hi") + reach).alias("t_event"),
        F.lit(-1).alias("change"),
        F.lit(2).alias("rank"),
    )
    return starts.unionByName(ends)


def neighbor_event_count(
    events: DataFrame, calendar: DataFrame, company: DataFrame, edges: DataFrame, days: int = 30
) -> DataFrame:
    """Peers (same sector or neighbour) with an event in the closed ``[T - days, T]``.

    Sector peers are counted on the sector's running number of symbols with a
    recent event. Only neighbours outside the sector are looked up one by one.
    """
    members = company.select("symbol", "sector")
    keys = events.select("symbol", "t_event").distinct()
    with_sector = keys.join(members, "symbol", "left")

    spans = _covered_spans(calendar, days)
    recent = total_at(
        with_sector.where(F.col("sector").isNotNull()).withColumn("rank", F.lit(1)),
        spans.join(members, "symbol").drop("symbol"),
        ["sector"],
        "t_event",
        name="sector_recent",
    ).drop("rank")
    dated = calendar.select(
        "symbol", F.col("t_event").alias("at"), F.lit(1).cast("bigint").alias("n")
    )
    outside = keys.join(_neighbours_outside(edges, members), "symbol")
    asked = outside.select(F.col("dst").alias("symbol"), "t_event").unionByName(keys)
    hits = interval_rollup(asked, dated, ["symbol"], sums=["n"], fact_ts="at", days=days)
    near = (
        outside.join(
            hits.select(F.col("symbol").alias("dst"), "t_event"), ["dst", "t_event"], "left_semi"
        )
        .groupBy("symbol", "t_event")
        .agg(F.count(F.lit(1)).alias("near"))
    )
    own = hits.select("symbol", "t_event", F.lit(1).alias("own"))
    return (
        with_sector.join(recent, ["sector", "t_event"], "left")
        .join(near, ["symbol", "t_event"], "left")
        .join(own, ["symbol", "t_event"], "left")
        .select(
            "symbol",
            "t_event",
            (
                F.coalesce(F.col("sector_recent") - F.coalesce("own", F.lit(0)), F.lit(0))
                + F.coalesce("near", F.lit(0))
            )
            .cast("int")
            .alias("neighbor_earnings_count_30d"),
        )
    )


def market_features(
    events: DataFrame, bars: DataFrame, calendar: DataFrame, company: DataFrame,
    edges: DataFrame, strict: bool = False,
) -> DataFrame:
    """All bar-derived features, keyed by (symbol, t_event)."""
    keys = events.select("symbol", "t_event").distinct()
    on = ["symbol", "t_event"]
    return (
        symbol_features(keys, bars, strict)
        .join(cohort_return(keys, bars, company), on, "full")
        .join(neighbor_event_count(keys, calendar, company, edges), on, "full")
    )


def enrich_events(events: DataFrame, features: DataFrame) -> DataFrame:
    """Add features to events; a value an event already has is kept."""
    on = ["symbol", "t_event"]
    added = [c for c in features.columns if c not in on]
    fresh = features.select(*on, *[F.col(c).alias(f"__{c}") for c in added])
    joined = events.join(fresh, on, "left")
    return joined.select(
        *[c for c in events.columns if c not in added],
        *[
            (F.coalesce(F.col(c), F.col(f"__{c}")) if c in events.columns else F.col(f"__{c}")).alias(c)
            for c in added
        ],
    )


def return_correlation(bars: DataFrame, pairs: DataFrame, lookback: int = 252) -> DataFrame:
    """Correlation of the last daily returns of each pair (``a``, ``b``), by date.

    0 with fewer than 10 common dates or where either side does not move.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("d").desc())
    last = (
        daily_returns(bars)
        .withColumn("age", F.row_number().over(newest))
        .where(F.col("age") <= lookback)
    )
    joined = (
        pairs.select("a", "b")
        .join(last.select(F.col("symbol").alias("a"), "d", F.col("return_pct").alias("x")), "a")
        .join(
            last.select(F.col("symbol").alias("b"), "d", F.col("return_pct").alias("y")), ["b", "d"]
        )
    )
    stats = joined.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("x").alias("sx"),
        F.stddev_samp("y").alias("sy"),
        F.corr("x", "y").alias("c"),
    )
    moves = (F.col("n") >= 10) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return (
        pairs.select("a", "b")
        .join(stats, ["a", "b"], "left")
        .select(
            "a",
            "b",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(moves, F.round("c", 4)).otherwise(F.lit(0.0)).alias("correlation"),
        )
    )


def daily_vol(bars: DataFrame, as_of=None, lookback: int = 60) -> DataFrame:
    """Percent standard deviation of returns over the last closes; 2.0 below 5."""
    upto = bars if as_of is None else bars.where(F.col("d") <= F.lit(as_of))
    newest = Window.partitionBy("symbol").orderBy(F.col("d").desc())
    kept = max(5, lookback)
    tail = (
        upto.select("symbol", "d", "close")
        .withColumn("age", F.row_number().over(newest))
        .where(F.col("age") <= kept)
    )
    prev = F.lag("close").over(_by_date())
    rets = tail.withColumn("ret", F.when(prev != 0, (F.col("close") - prev) / prev))
    vol = F.stddev_samp("ret") * 100.0
    return rets.groupBy("symbol").agg(
        F.when(F.count("close") < 5, F.lit(2.0))
        .otherwise(F.round(F.coalesce(vol, F.lit(2.0)), 4))
        .alias("daily_vol_pct")
    )


def live_pre_return(bars: DataFrame, as_of, bars_back: int = 7) -> DataFrame:
    """Last close against 7 bars earlier, from bars of the last 45 days; null below 8."""
    day = F.lit(as_of).cast("date")
    recent = bars.where(F.col("d").between(F.date_sub(day, 45), day))
    return (
        recent.select(
            "symbol",
            "d",
            "close",
            F.lag("close", bars_back).over(_by_date()).alias("then"),
            F.lead("d").over(_by_date()).alias("later"),
        )
        .where(F.col("later").isNull())
        .select(
            "symbol",
            F.col("d").alias("last_d"),
            F.col("close").alias("spot"),
            pct_change(F.col("then"), F.col("close")).alias("pre_7d_return_pct"),
        )
    )


def structure_features(bars: DataFrame, period: int = 14, lookback: int = 5) -> DataFrame:
    """Average true range, swing levels, retracements and prior-day sweeps per bar."""
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    prev_close = F.lag("close").over(_by_date())
    true_range = F.greatest(F.abs(high - low), F.abs(high - prev_close), F.abs(low - prev_close))
    pdh, pdl = F.lag("high").over(_by_date()), F.lag("low").over(_by_date())
    swing = _by_date().rowsBetween(-(lookback - 1), 0)
    base = bars.withColumns(
        {
            "idx": bar_index(),
            "tr": true_range,
            "prior_day_high": pdh,
            "prior_day_low": pdl,
            "is_last": F.lead("d").over(_by_date()).isNull(),
        }
    )
    atr = F.avg("tr").over(_by_date().rowsBetween(-(period - 1), 0))
    with_swing = base.withColumns(
        {
            "atr_pct": F.when((F.col("idx") >= period) & (close > 0), atr / close * 100.0),
            "swing_high": F.when(F.col("idx") >= lookback - 1, F.max("high").over(swing)),
            "swing_low": F.when(F.col("idx") >= lookback - 1, F.min("low").over(swing)),
        }
    )
    span = F.col("swing_high") - F.col("swing_low")

    def fib(share: float) -> Column:
        return F.when(span > 0, F.col("swing_high") - share * span)

    sweep = (
        F.when((low < F.col("prior_day_low")) & (close > F.col("prior_day_low")), F.lit("bullish"))
        .when((high > F.col("prior_day_high")) & (close < F.col("prior_day_high")), F.lit("bearish"))
        .otherwise(F.lit("none"))
    )
    return with_swing.withColumns(
        {
            "fib_382": fib(0.382),
            "fib_500": fib(0.500),
            "fib_618": fib(0.618),
            "liquidity_sweep": sweep,
        }
    ).drop("tr")


def structure_levels(bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Structure features of each symbol's latest bar."""
    return structure_features(bars, lookback=lookback).where("is_last").drop("is_last", "idx")


def session_returns(bars: DataFrame) -> DataFrame:
    """Open-to-close percent return per bar; bars with open 0 are left out."""
    return bars.where(F.col("open") != 0).select(
        "symbol", "d", pct_change(F.col("open"), F.col("close")).alias("session_return_pct")
    )
