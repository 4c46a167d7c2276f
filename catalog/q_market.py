"""Bars, labels and market features."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.ctes import pct, r, sign
from tidemark.core import asof_join
from tidemark.operators import evaluation as ev
from tidemark.operators import market as mk


def labelled(spark, sf):
    return mk.baseline_events(v.earnings_shifted(spark, sf), v.bars(spark, sf))


@query(
    "baseline_accuracy",
    """SELECT count(*) AS events,
         count(*) FILTER (baseline_pred_sign <> 0 AND actual_sign <> 0) AS scored,
         count(*) FILTER (baseline_pred_sign <> 0 AND baseline_pred_sign = actual_sign) AS correct,
         round(count(*) FILTER (baseline_pred_sign <> 0 AND baseline_pred_sign = actual_sign)
           / count(*) FILTER (baseline_pred_sign <> 0 AND actual_sign <> 0), 4) AS accuracy
       FROM ev""",
)
def baseline_accuracy(spark, sf):
    return ev.sign_accuracy(labelled(spark, sf), "baseline_pred_sign")


@query("baseline_events", "SELECT * EXCLUDE (idx) FROM ev")
def baseline_events(spark, sf):
    return labelled(spark, sf)


@query(
    "asof_forward",
    """SELECT e.symbol, e.t_event, b.d, b.close
        FROM earnings_shifted e ASOF JOIN bars b
          ON e.symbol = b.symbol AND CAST(e.t_event AS DATE) <= b.d""",
)
def asof_forward(spark, sf):
    return asof_join(v.earnings_shifted(spark, sf), v.bars(spark, sf).select("symbol", "d", "close"))


@query(
    "asof_backward",
    """SELECT e.symbol, e.t_event, b.d, b.close
        FROM earnings_shifted e ASOF JOIN bars b
          ON e.symbol = b.symbol AND CAST(e.t_event AS DATE) >= b.d""",
)
def asof_backward(spark, sf):
    return asof_join(
        v.earnings_shifted(spark, sf),
        v.bars(spark, sf).select("symbol", "d", "close"),
        direction="backward",
    )


@query(
    "next_session",
    """SELECT e.symbol, e.t_event, b.d AS session_date
       FROM earnings e ASOF JOIN (SELECT DISTINCT d FROM index_bars) b
         ON CAST(e.t_event AS DATE) < b.d""",
)
def next_session(spark, sf):
    from tidemark.operators.sessions import assign_session

    return assign_session(v.earnings(spark, sf), v.index_bars(spark, sf))


@query(
    "bar_offsets",
    f"""SELECT symbol, d, CAST(idx AS INTEGER) AS idx, {r('pre_7')} AS pre_7,
          {r('post_5')} AS post_5, {r('last_5')} AS last_5 FROM bar_facts""",
)
def bar_offsets(spark, sf):
    return mk.bar_features(v.bars(spark, sf)).select(
        "symbol",
        "d",
        "idx",
        *[F.round(c, 6).alias(c) for c in ("pre_7", "post_5", "last_5")],
    )


def _prior_drift_sql(strict: bool, rows: str = "earnings_shifted") -> str:
    guard = "p.idx + 5 <= s.idx AND" if strict else ""
    return f"""
        WITH placed AS (
          SELECT e.symbol, e.t_event, b.idx, b.pre_30, b.pre_60, b.vol_30, b.post_5,
                 lag(e.t_event) OVER (PARTITION BY e.symbol ORDER BY e.t_event) AS prev_t
          FROM {rows} e ASOF JOIN bar_facts b
            ON e.symbol = b.symbol AND CAST(e.t_event AS DATE) <= b.d)
        SELECT s.symbol, s.t_event, coalesce(round(s.pre_30, 4), 0) AS pre_30d_return_pct,
          coalesce(round(s.pre_60, 4), 0) AS pre_60d_return_pct,
          coalesce(round(s.vol_30, 4), 0) AS pre_30d_vol_pct,
          coalesce(CASE WHEN {guard} true THEN round(p.post_5, 4) END, 0)
            AS prior_post_earnings_5d_return_pct
        FROM placed s LEFT JOIN placed p ON p.symbol = s.symbol AND p.t_event = s.prev_t"""


@query("momentum_and_volatility", _prior_drift_sql(False))
def momentum_and_volatility(spark, sf):
    return mk.symbol_features(v.earnings_shifted(spark, sf), v.bars(spark, sf))


@query("prior_drift_strict", _prior_drift_sql(True))
def prior_drift_strict(spark, sf):
    return mk.symbol_features(v.earnings_shifted(spark, sf), v.bars(spark, sf), strict=True)


@query(
    "peer_counts",
    """SELECT c.symbol, count(DISTINCT p.peer) AS peers,
         count(DISTINCT p.peer) FILTER (p.same) AS sector_peers,
         count(DISTINCT p.peer) FILTER (NOT p.same) AS outside_neighbours
       FROM company c LEFT JOIN (
         SELECT a.symbol, b.symbol AS peer, true AS same
           FROM company a JOIN company b ON a.sector = b.sector AND a.symbol <> b.symbol
         UNION ALL
         SELECT e.src, e.dst, false FROM edges e JOIN company a ON a.symbol = e.src
           JOIN company b ON b.symbol = e.dst WHERE a.sector <> b.sector) p
         ON p.symbol = c.symbol
       GROUP BY c.symbol""",
)
def peer_counts(spark, sf):
    return mk.peer_counts(v.company(spark, sf), v.edges(spark, sf))


_COHORT = """
    SELECT e.symbol, e.t_event, coalesce(round(avg(b.last_5), 4), 0) AS sector_cohort_5d_return_pct
    FROM earnings_shifted e JOIN company c ON c.symbol = e.symbol
    LEFT JOIN (
      SELECT ev.symbol, ev.t_event, p.peer, x.last_5
      FROM earnings_shifted ev
      JOIN company a ON a.symbol = ev.symbol
      JOIN (SELECT symbol AS peer, sector FROM company) p
        ON p.sector = a.sector AND p.peer <> ev.symbol
      ASOF JOIN bar_facts x ON x.symbol = p.peer AND CAST(ev.t_event AS DATE) <= x.d) b
      ON b.symbol = e.symbol AND b.t_event = e.t_event
    GROUP BY e.symbol, e.t_event"""


@query("sector_cohort_return", _COHORT)
def sector_cohort_return(spark, sf):
    return mk.cohort_return(
        v.earnings_shifted(spark, sf), v.bars(spark, sf), v.company(spark, sf)
    )


_NEIGHBOURS = """
    SELECT e.symbol, e.t_event, CAST(count(DISTINCT n.peer) AS INTEGER) AS neighbor_earnings_count_30d
    FROM earnings_shifted e LEFT JOIN (
      SELECT e.symbol, e.t_event, p.peer
      FROM earnings_shifted e
      JOIN (SELECT a.symbol, b.symbol AS peer
              FROM company a JOIN company b ON a.sector = b.sector AND a.symbol <> b.symbol
            UNION SELECT src, dst FROM edges) p ON p.symbol = e.symbol
      JOIN earnings_shifted o ON o.symbol = p.peer
        AND o.t_event BETWEEN e.t_event - INTERVAL 30 DAYS AND e.t_event) n
      ON n.symbol = e.symbol AND n.t_event = e.t_event
    GROUP BY e.symbol, e.t_event"""


@query("neighbor_event_count", _NEIGHBOURS)
def neighbor_event_count(spark, sf):
    events = v.earnings_shifted(spark, sf)
    return mk.neighbor_event_count(events, events, v.company(spark, sf), v.edges(spark, sf))


def enriched_sql(rows: str = "earnings_shifted") -> str:
    """Events with their price features; prior events are those of ``rows``."""
    return f"""
        SELECT x.* EXCLUDE (idx), m.pre_30d_return_pct, m.pre_60d_return_pct, m.pre_30d_vol_pct,
          m.prior_post_earnings_5d_return_pct, c.sector_cohort_5d_return_pct,
          n.neighbor_earnings_count_30d
        FROM ev x JOIN ({_prior_drift_sql(False, rows)}) m USING (symbol, t_event)
          JOIN ({_COHORT}) c USING (symbol, t_event)
          JOIN ({_NEIGHBOURS}) n USING (symbol, t_event)"""


@query(
    "enriched_events",
    enriched_sql(),
)
def enriched_events(spark, sf):
    events = v.earnings_shifted(spark, sf)
    features = mk.market_features(
        events, v.bars(spark, sf), events, v.company(spark, sf), v.edges(spark, sf)
    )
    return mk.enrich_events(labelled(spark, sf), features)


@query(
    "daily_returns",
    f"""SELECT symbol, d, {r('return_pct')} AS return_pct FROM (
          SELECT symbol, d, 100.0 * ret AS return_pct FROM bar_facts) WHERE return_pct IS NOT NULL""",
)
def daily_returns(spark, sf):
    return mk.daily_returns(v.bars(spark, sf)).withColumn("return_pct", F.round("return_pct", 6))


@query(
    "return_correlation",
    """WITH last_returns AS (
         SELECT symbol, d, 100.0 * ret AS x FROM bar_facts WHERE ret IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 252)
       SELECT e.src AS a, e.dst AS b, count(l.x) AS n,
         CASE WHEN count(l.x) >= 10 THEN round(corr(l.x, l.y), 4) ELSE 0 END AS correlation
       FROM edges e LEFT JOIN (
         SELECT p.symbol AS a, q.symbol AS b, p.x, q.x AS y
         FROM last_returns p JOIN last_returns q ON p.d = q.d) l ON l.a = e.src AND l.b = e.dst
       GROUP BY e.src, e.dst""",
)
def return_correlation(spark, sf):
    pairs = v.edges(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return mk.return_correlation(v.bars(spark, sf), pairs)


@query(
    "daily_volatility",
    f"""SELECT symbol, CASE WHEN count(*) < 5 THEN 2.0
          ELSE round(100.0 * stddev_samp(ret), 4) END AS daily_vol_pct
        FROM (SELECT symbol, d, (close - lag(close) OVER w) / lag(close) OVER w AS ret
              FROM (SELECT * FROM bars WHERE d <= DATE '{v.AS_OF}'
                    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 60)
              WINDOW w AS (PARTITION BY symbol ORDER BY d))
        GROUP BY symbol""",
)
def daily_volatility(spark, sf):
    return mk.daily_vol(v.bars(spark, sf), v.AS_OF)


@query(
    "live_pre_return",
    f"""SELECT symbol, d AS last_d, close AS spot, {r(pct('then_close', 'close'))} AS pre_7d_return_pct
        FROM (SELECT symbol, d, close, lag(close, 7) OVER (PARTITION BY symbol ORDER BY d) AS then_close
              FROM bars WHERE d BETWEEN DATE '{v.AS_OF}' - INTERVAL 45 DAYS AND DATE '{v.AS_OF}')
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1""",
)
def live_pre_return(spark, sf):
    out = mk.live_pre_return(v.bars(spark, sf), v.AS_OF)
    return out.withColumn("pre_7d_return_pct", F.round("pre_7d_return_pct", 6))


_TR = """greatest(abs(high - low), coalesce(abs(high - lag(close) OVER w), 0),
                  coalesce(abs(low - lag(close) OVER w), 0))"""
_STRUCTURE = f"""
    SELECT *, CASE WHEN swing_high > swing_low THEN swing_high - 0.382 * (swing_high - swing_low) END AS fib_382,
      CASE WHEN swing_high > swing_low THEN swing_high - 0.5 * (swing_high - swing_low) END AS fib_500,
      CASE WHEN swing_high > swing_low THEN swing_high - 0.618 * (swing_high - swing_low) END AS fib_618,
      CASE WHEN low < prior_day_low AND close > prior_day_low THEN 'bullish'
           WHEN high > prior_day_high AND close < prior_day_high THEN 'bearish'
           ELSE 'none' END AS liquidity_sweep
    FROM (
      SELECT symbol, d, open, high, low, close, idx, prior_day_high, prior_day_low,
        CASE WHEN idx >= 14 AND close > 0 THEN 100.0 * avg(tr) OVER (
          PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING) / close END AS atr_pct,
        CASE WHEN idx >= 4 THEN max(high) OVER (
          PARTITION BY symbol ORDER BY d ROWS 4 PRECEDING) END AS swing_high,
        CASE WHEN idx >= 4 THEN min(low) OVER (
          PARTITION BY symbol ORDER BY d ROWS 4 PRECEDING) END AS swing_low
      FROM (SELECT *, row_number() OVER w - 1 AS idx, {_TR} AS tr,
              lag(high) OVER w AS prior_day_high, lag(low) OVER w AS prior_day_low
            FROM tick_bars WINDOW w AS (PARTITION BY symbol ORDER BY d)))"""


@query(
    "structure_by_bar",
    f"""SELECT symbol, d, {r('atr_pct')} AS atr_pct, swing_high, swing_low, {r('fib_382')} AS fib_382,
          {r('fib_500')} AS fib_500, {r('fib_618')} AS fib_618, prior_day_high, prior_day_low,
          liquidity_sweep FROM ({_STRUCTURE})""",
)
def structure_by_bar(spark, sf):
    rounded = ("atr_pct", "fib_382", "fib_500", "fib_618")
    return mk.structure_features(v.tick_bars(spark, sf)).select(
        "symbol",
        "d",
        *[F.round(c, 6).alias(c) for c in rounded],
        "swing_high",
        "swing_low",
        "prior_day_high",
        "prior_day_low",
        "liquidity_sweep",
    )


@query(
    "structure_levels",
    f"""SELECT symbol, d, close, {r('atr_pct')} AS atr_pct, swing_high, swing_low,
          {r('fib_382')} AS fib_382, {r('fib_500')} AS fib_500, {r('fib_618')} AS fib_618,
          prior_day_high, prior_day_low, liquidity_sweep
        FROM ({_STRUCTURE}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1""",
)
def structure_levels(spark, sf):
    rounded = ("atr_pct", "fib_382", "fib_500", "fib_618")
    return mk.structure_levels(v.tick_bars(spark, sf)).select(
        "symbol",
        "d",
        "close",
        *[F.round(c, 6).alias(c) for c in rounded],
        "swing_high",
        "swing_low",
        "prior_day_high",
        "prior_day_low",
        "liquidity_sweep",
    )


@query(
    "session_returns",
    f"""SELECT symbol, d, {r(pct('open', 'close'))} AS session_return_pct
        FROM tick_bars WHERE open <> 0""",
)
def session_returns(spark, sf):
    return mk.session_returns(v.tick_bars(spark, sf)).withColumn(
        "session_return_pct", F.round("session_return_pct", 6)
    )


@query(
    "sign_and_direction",
    f"""SELECT symbol, d, {sign('x', 0.15)} AS label_sign, {sign('x', 0.1)} AS signal_sign,
          {sign('x', 0.05)} AS sector_sign,
          CASE WHEN x > 0.05 THEN 'up' WHEN x < -0.05 THEN 'down' ELSE 'flat' END AS move,
          CASE WHEN x > 0.1 THEN 'bullish' WHEN x < -0.1 THEN 'bearish' ELSE 'mixed' END AS market,
          CASE WHEN x > 0.15 THEN 'long' WHEN x < -0.15 THEN 'short' ELSE 'flat' END AS trade
        FROM (SELECT symbol, d, 100.0 * ret / 20.0 AS x FROM bar_facts WHERE ret IS NOT NULL)""",
)
def sign_and_direction(spark, sf):
    from tidemark import fixed_values as fx
    from tidemark.functions.signals import direction, sign_dz

    rets = mk.daily_returns(v.bars(spark, sf))
    x = F.col("return_pct") / 20.0
    signs = rets.select(
        "symbol",
        "d",
        sign_dz(x, fx.LABEL_DEAD_ZONE).alias("label_sign"),
        sign_dz(x, fx.SIGNAL_DEAD_ZONE).alias("signal_sign"),
        sign_dz(x, fx.SECTOR_DEAD_ZONE).alias("sector_sign"),
    )
    return signs.withColumns(
        {
            "move": direction(F.col("sector_sign"), "move"),
            "market": direction(F.col("signal_sign")),
            "trade": direction(F.col("label_sign"), "trade"),
        }
    )
