"""Trades, barriers, strategy metrics and sessions."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.ctes import r, shortest
from catalog.q_market import labelled
from tidemark.functions import signals as sg
from tidemark.operators import evaluation as ev
from tidemark.operators import market as mk
from tidemark.operators import sessions as ss
from tidemark.operators import trades as tr
from tidemark.session import cut_lineage


def signalled(spark, sf):
    """Labelled events with a contrarian signal, as the SQL view ``signals``."""
    pre = F.col("baseline_pre_7d_return_pct")
    return labelled(spark, sf).withColumns(
        {
            "enhanced_pred_sign": -F.signum(pre).cast("int"),
            "enhanced_confidence": F.round(F.least(F.lit(1.0), 0.15 + F.abs(pre) / 120.0), 4),
        }
    )


# --- scalar rules ------------------------------------------------------------

_WEIGHT = "least(1e0, greatest(25e-2, 25e-2 + greatest(0e0, least(1e0, conf)) * 75e-2))"
_GIVEN = "CASE WHEN conf > 0.5 THEN conf ELSE least(1e0, 15e-2 + abs(actual_5d_return_pct) / 12e0) END"


@query(
    "trade_rules",
    f"""SELECT trade_key, {shortest(_WEIGHT)} AS position_weight,
          sign * actual_5d_return_pct AS gross, {r('sign * actual_5d_return_pct - 1e-1')} AS net,
          {r(_GIVEN)} AS confidence,
          CASE WHEN conf < 0.55 THEN '0.50-0.55' WHEN conf < 0.60 THEN '0.55-0.60'
               WHEN conf < 0.70 THEN '0.60-0.70' WHEN conf < 0.80 THEN '0.70-0.80'
               ELSE '>=0.80' END AS bucket FROM trades""",
)
def trade_rules(spark, sf):
    conf, ret, side = F.col("conf"), F.col("actual_5d_return_pct"), F.col("sign")
    given = F.when(conf > 0.5, conf)
    return v.trades(spark, sf).select(
        "trade_key",
        sg.position_weight(conf).alias("position_weight"),
        sg.gross_return(side, ret).alias("gross"),
        F.round(sg.net_return(side, ret), 6).alias("net"),
        F.round(sg.signal_confidence(given, ret), 6).alias("confidence"),
        sg.confidence_bucket(conf).alias("bucket"),
    )


@query(
    "numbers_or_zero",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k,
         0.0 AS absent,
         CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) ELSE 0.0 END AS mixed
       FROM events""",
)
def numbers_or_zero(spark, sf):
    raw = v.table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("event_id").cast("string"))
        .otherwise(F.lit("n/a"))
        .alias("mixed"),
    )
    return sg.num0_columns(raw, ["k", "mixed", "absent"])


# --- signals to trades -------------------------------------------------------

_SIM = f"""
    SELECT *, sign <> 0 AND conf >= 0.15 AS taken,
      {shortest('sign * actual_5d_return_pct')} AS gross_return_pct,
      {shortest('sign * actual_5d_return_pct - 1e-1')} AS net_return_pct,
      {shortest(_WEIGHT)} AS position_weight FROM trades"""


@query(
    "simulated_trades",
    f"""SELECT trade_key, taken, gross_return_pct, net_return_pct, position_weight,
          sign * actual_5d_return_pct - 1e-1 > 0 AS won FROM ({_SIM})""",
)
def simulated_trades(spark, sf):
    return tr.simulate_signal(v.trades(spark, sf), "sign", "conf").select(
        "trade_key", "taken", "gross_return_pct", "net_return_pct", "position_weight", "won"
    )


def trade_order():
    return [F.col("t_event"), F.col("trade_key")]


def trade_chunks():
    return [F.to_date("t_event")]


def metrics_sql(rows: str, by: str, ret: str = "net_return_pct * position_weight",
                order: str = "t_event, trade_key", extra: str = "") -> str:
    """Strategy metrics of ``rows`` (with ``taken``) per ``by``."""
    return f"""
      SELECT a.{by}, a.trades, a.skipped, a.hit_rate, a.mean_trade_return_pct,
        a.median_trade_return_pct, a.cumulative_return_pct, d.max_drawdown_pct, a.sharpe_ratio,
        a.total_wins, a.total_losses {extra}
      FROM (
        SELECT {by}, count(*) FILTER (taken) AS trades, count(*) FILTER (NOT taken) AS skipped,
          round(count(*) FILTER (taken AND {ret} > 0) / nullif(count(*) FILTER (taken), 0), 4) AS hit_rate,
          round(avg({ret}) FILTER (taken), 4) AS mean_trade_return_pct,
          round(median({ret}) FILTER (taken), 4) AS median_trade_return_pct,
          round((product(1 + {ret} / 100.0) FILTER (taken) - 1) * 100.0, 4) AS cumulative_return_pct,
          CASE WHEN stddev_samp({ret}) FILTER (taken) > 0 THEN
            round(avg({ret}) FILTER (taken) / stddev_samp({ret}) FILTER (taken) * sqrt(50.0), 4) END
            AS sharpe_ratio,
          count(*) FILTER (taken AND {ret} > 0) AS total_wins,
          count(*) FILTER (taken AND {ret} <= 0) AS total_losses
        FROM {rows} GROUP BY {by}) a
      LEFT JOIN (
        SELECT {by}, round(max((peak - equity) / peak * 100.0), 4) AS max_drawdown_pct
        FROM (SELECT {by}, equity, greatest(1.0, max(equity) OVER (
                PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) AS peak
              FROM (SELECT {by}, {order}, product(1 + {ret} / 100.0) OVER (
                      PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS equity
                    FROM {rows} WHERE taken))
        GROUP BY {by}) d ON d.{by} = a.{by}"""


def digits(value):
    """Signed digits of a number, to compare growth and drawdown of many large moves."""
    return F.round(F.signum(value) * F.log10(1 + F.abs(value)), 6)


def digits_sql(value: str) -> str:
    return f"round(sign({value}) * log10(1 + abs({value})), 6)"


# These bars move by hundreds of percent, so growth and drawdown are compared by their digits.
DRAWN = f"""trades, skipped, hit_rate, mean_trade_return_pct, median_trade_return_pct, sharpe_ratio,
    total_wins, total_losses, {digits_sql("cumulative_return_pct")} AS growth_digits,
    {digits_sql("max_drawdown_pct")} AS drawdown_digits"""


def with_digits(metrics):
    """Growth and drawdown as digits, in place of the numbers."""
    return metrics.withColumns(
        {"growth_digits": digits("cumulative_return_pct"), "drawdown_digits": digits("max_drawdown_pct")}
    ).drop("cumulative_return_pct", "max_drawdown_pct")


@query("strategy_metrics", metrics_sql(f"({_SIM})", "strategy"))
def strategy_metrics(spark, sf):
    rows = tr.simulate_signal(v.trades(spark, sf), "sign", "conf")
    return tr.strategy_metrics(rows, ["strategy"], trade_order(), trade_chunks())


@query(
    "best_strategy",
    f"""SELECT strategy, cumulative_return_pct, trades FROM ({metrics_sql(f"({_SIM})", "strategy")})
        ORDER BY cumulative_return_pct DESC, strategy LIMIT 1""",
)
def best_strategy(spark, sf):
    rows = tr.simulate_signal(v.trades(spark, sf), "sign", "conf")
    metrics = tr.strategy_metrics(rows, ["strategy"], trade_order(), trade_chunks())
    place = F.ascii("strategy")
    return tr.best_by(
        metrics.select("strategy", "cumulative_return_pct", "trades").withColumn("place", place),
        "cumulative_return_pct",
        "place",
    ).drop("place")


@query(
    "dashboard_strategies",
    f"""SELECT strategy, trades, hit_rate, cumulative_return_pct, sharpe_ratio, max_drawdown_pct,
          mean_trade_return_pct FROM ({metrics_sql(f"({_SIM})", "strategy")})""",
)
def dashboard_strategies(spark, sf):
    rows = tr.simulate_signal(v.trades(spark, sf), "sign", "conf")
    return ev.dashboard_strategies(
        tr.strategy_metrics(rows, ["strategy"], trade_order(), trade_chunks())
    )


@query(
    "equity_curve",
    f"""SELECT strategy, trade_key, round(equity, 6) AS equity,
          round((equity - peak) / peak * 100.0, 6) AS drawdown_pct
        FROM (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY strategy
                ORDER BY t_event, trade_key ROWS UNBOUNDED PRECEDING)) AS peak
              FROM (SELECT strategy, t_event, trade_key,
                      product(1 + net_return_pct * position_weight / 100.0) OVER (
                        PARTITION BY strategy ORDER BY t_event, trade_key
                        ROWS UNBOUNDED PRECEDING) AS equity
                    FROM ({_SIM}) WHERE taken))""",
)
def equity_curve(spark, sf):
    rows = tr.simulate_signal(v.trades(spark, sf), "sign", "conf").where("taken")
    weighted = rows.withColumn("ret", F.col("net_return_pct") * F.col("position_weight"))
    curve = tr.equity_curve(weighted, "ret", trade_order(), trade_chunks(), ["strategy"])
    return curve.select(
        "strategy", "trade_key", *[F.round(c, 6).alias(c) for c in ("equity", "drawdown_pct")]
    )


@query(
    "recent_trades",
    """SELECT strategy, trade_key, actual_5d_return_pct FROM trades
       ORDER BY t_event DESC, trade_key DESC LIMIT 50""",
)
def recent_trades(spark, sf):
    from tidemark.operators.documents import latest

    rows = v.trades(spark, sf)
    newest = [F.col("t_event").desc(), F.col("trade_key").desc()]
    return latest(rows.select("strategy", "trade_key", "actual_5d_return_pct", "t_event"), newest, 50).drop(
        "t_event"
    )


# --- levels and barriers -----------------------------------------------------

_LEVELS = """
    SELECT *, round(greatest(1.0, least(8.0, 0.45 * move + 0.65 * vol)), 4) AS stop_pct,
      round(greatest(1.5 * round(greatest(1.0, least(8.0, 0.45 * move + 0.65 * vol)), 4),
                     0.55 * move), 4) AS target_pct
    FROM (
      SELECT s.symbol, s.t_event, s.enhanced_confidence, s.baseline_pre_7d_return_pct, b.d,
        CASE WHEN s.enhanced_pred_sign <> 0 THEN s.enhanced_pred_sign
             ELSE s.baseline_pred_sign END AS signal,
        abs(s.baseline_pre_7d_return_pct) AS move, b.close AS entry, b.idx,
        CASE WHEN round(b.vol_60, 4) > 0 THEN round(b.vol_60, 4)
             ELSE greatest(1.0, least(4.0, abs(s.baseline_pre_7d_return_pct) / 3.0)) END AS vol
      FROM signals s ASOF JOIN bar_facts b
        ON s.symbol = b.symbol AND CAST(s.t_event AS DATE) <= b.d)
    WHERE signal <> 0 AND entry > 0"""

_PRICED = f"""
    SELECT l.*, {shortest('entry * (1 - sign(signal) * stop_pct / 100.0)')} AS stop_price,
      {shortest('entry * (1 + sign(signal) * target_pct / 100.0)')} AS target_price,
      CASE WHEN signal > 0 THEN 'long' ELSE 'short' END AS trade_direction,
      CASE WHEN signal < 0 THEN h.hedge END AS suggested_hedge
    FROM ({_LEVELS}) l LEFT JOIN company c ON c.symbol = l.symbol
    LEFT JOIN hedges h ON h.sector = c.sector"""


@query(
    "swing_plans",
    f"""SELECT symbol, t_event, signal, stop_pct, target_pct, stop_price, target_price,
          trade_direction, suggested_hedge FROM ({_PRICED})""",
)
def swing_plans(spark, sf):
    return trade_paths(spark, sf).select(
        "symbol",
        "t_event",
        "signal",
        "stop_pct",
        "target_pct",
        "stop_price",
        "target_price",
        "trade_direction",
        "suggested_hedge",
    )


def trade_paths(spark, sf):
    # The events feed both sides of the as-of join: write them once.
    return tr.trade_paths(
        cut_lineage(signalled(spark, sf)),
        v.bars(spark, sf),
        v.hedges(spark, sf),
        v.company(spark, sf),
    )


PATHS = f"""
    SELECT p.symbol, p.t_event, p.signal, p.enhanced_confidence, p.baseline_pre_7d_return_pct,
      CASE WHEN f.day IS NULL THEN 'time' WHEN f.stopped THEN 'stop' ELSE 'target' END
        AS path_exit_reason,
      coalesce(f.day, t.n) AS path_holding_days,
      sign(p.signal) * (CASE WHEN f.day IS NULL THEN t.last_close WHEN f.stopped THEN p.stop_price
                             ELSE p.target_price END - p.entry) / p.entry * 100.0 AS ret
    FROM ({_PRICED}) p
    JOIN (SELECT q.symbol, q.t_event, count(*) AS n, max_by(b.close, b.idx) AS last_close
          FROM ({_PRICED}) q JOIN bar_facts b ON b.symbol = q.symbol
            AND b.idx BETWEEN q.idx + 1 AND q.idx + 5
          GROUP BY q.symbol, q.t_event) t ON t.symbol = p.symbol AND t.t_event = p.t_event
    LEFT JOIN (
      SELECT q.symbol, q.t_event, min(b.idx - q.idx) AS day,
        min_by(CASE WHEN q.signal > 0 THEN b.low <= q.stop_price ELSE b.high >= q.stop_price END,
               b.idx) AS stopped
      FROM ({_PRICED}) q JOIN bar_facts b ON b.symbol = q.symbol
        AND b.idx BETWEEN q.idx + 1 AND q.idx + 5
      WHERE CASE WHEN q.signal > 0 THEN b.low <= q.stop_price OR b.high >= q.target_price
                 ELSE b.high >= q.stop_price OR b.low <= q.target_price END
      GROUP BY q.symbol, q.t_event) f ON f.symbol = p.symbol AND f.t_event = p.t_event"""


@query(
    "barrier_outcomes",
    f"""SELECT symbol, t_event, path_exit_reason, path_holding_days, round(ret, 4) AS path_return_pct,
          path_exit_reason = 'stop' AS path_stop_hit, path_exit_reason = 'target' AS path_target_hit,
          ret > 0 AS path_won FROM ({PATHS})""",
)
def barrier_outcomes(spark, sf):
    return trade_paths(spark, sf).select(
        "symbol",
        "t_event",
        "path_exit_reason",
        "path_holding_days",
        "path_return_pct",
        "path_stop_hit",
        "path_target_hit",
        "path_won",
    )


@query(
    "path_summary",
    f"""SELECT count(*) AS events_with_path, round(avg(CAST(ret > 0 AS INTEGER)), 4) AS path_win_rate,
          round(avg(CAST(path_exit_reason = 'stop' AS INTEGER)), 4) AS stop_hit_rate,
          round(avg(CAST(path_exit_reason = 'target' AS INTEGER)), 4) AS target_hit_rate,
          round(avg(CAST(round(ret, 4) > 0 AS INTEGER)), 4) AS direction_accuracy_with_stops,
          round(avg(round(ret, 4)), 4) AS mean_path_return_pct FROM ({PATHS})""",
)
def path_summary(spark, sf):
    return ev.path_summary(trade_paths(spark, sf))


_PATH_TRADES = f"""
    SELECT *, 'path' AS strategy, symbol AS trade_key, enhanced_confidence >= 0.15 AS taken,
      round(round(ret, 4) - 0.1, 4) AS net_return_pct,
      {shortest('least(1e0, greatest(25e-2, 25e-2 + enhanced_confidence * 75e-2))')} AS position_weight
    FROM ({PATHS})"""


@query(
    "path_strategy_metrics",
    f"""SELECT m.* EXCLUDE (strategy, cumulative_return_pct),
          round(log10(1 + cumulative_return_pct / 100.0), 6) AS log10_growth, s.stop_hit_rate, s.target_hit_rate
        FROM ({metrics_sql(f"({_PATH_TRADES})", "strategy")}) m,
          (SELECT round(avg(CAST(path_exit_reason = 'stop' AS INTEGER)) FILTER (taken), 4) AS stop_hit_rate,
             round(avg(CAST(path_exit_reason = 'target' AS INTEGER)) FILTER (taken), 4) AS target_hit_rate
           FROM ({_PATH_TRADES})) s""",
)
def path_strategy_metrics(spark, sf):
    rows = tr.path_trades(cut_lineage(trade_paths(spark, sf)), signal="signal")
    order = [F.col("t_event"), F.col("symbol")]
    metrics = tr.strategy_metrics(rows, [], order, [F.to_date("t_event")], path=True)
    # These bars move by hundreds of percent; the growth is shown as a power of ten.
    growth = F.round(F.log10(1 + F.col("cumulative_return_pct") / 100.0), 6)
    return metrics.withColumn("log10_growth", growth).drop("cumulative_return_pct")


# --- sessions ----------------------------------------------------------------

_PLACED = """
    SELECT s.*, b.d AS session_date FROM signals s ASOF JOIN index_bars b
      ON CAST(s.t_event AS DATE) < b.d WHERE s.enhanced_pred_sign <> 0"""


def _sessions_sql(part: str, join: str = "") -> str:
    """Signed sums are added up as decimals, where signals can cancel exactly."""
    return f"""
      SELECT g.d AS session_date, CASE WHEN agg > 0 THEN 1 ELSE -1 END AS direction,
        round(CAST(agg AS DOUBLE), 4) AS agg_score, n_events, symbols,
        CASE WHEN abs(agg) / n_events < 0.55 THEN '0.50-0.55' WHEN abs(agg) / n_events < 0.60 THEN '0.55-0.60'
             WHEN abs(agg) / n_events < 0.70 THEN '0.60-0.70' WHEN abs(agg) / n_events < 0.80 THEN '0.70-0.80'
             ELSE '>=0.80' END AS confidence_bucket,
        round((close - open) / open * 100.0, 4) AS session_return_pct,
        round(CASE WHEN agg > 0 THEN 1 ELSE -1 END * (close - open) / open * 100.0, 4)
          AS directional_return_pct,
        CASE WHEN agg > 0 THEN 1 ELSE -1 END * (close - open) > 0 AS hit
      FROM (SELECT session_date AS d, sum(CAST({part} AS DECIMAL(28,10))) AS agg, count(*) AS n_events,
              string_agg(DISTINCT p.symbol, ',' ORDER BY p.symbol) AS symbols
            FROM ({_PLACED}) p {join} GROUP BY session_date) g
      JOIN index_bars b ON b.d = g.d WHERE agg <> 0 AND open <> 0"""


EQUAL = _sessions_sql("enhanced_pred_sign * enhanced_confidence")
CAP = _sessions_sql(
    "enhanced_pred_sign * enhanced_confidence * w.weight",
    "JOIN cap_weight w ON w.symbol = p.symbol",
)
_SESSION_COLUMNS = (
    "session_date", "direction", "agg_score", "n_events", "symbols", "confidence_bucket",
    "session_return_pct", "directional_return_pct", "hit",
)


def session_signals(spark, sf):
    return (
        signalled(spark, sf)
        .select(
            "symbol",
            "t_event",
            F.col("enhanced_pred_sign").alias("sign"),
            F.col("enhanced_confidence").alias("confidence"),
        )
        .join(v.cap_weight(spark, sf), "symbol", "left")
    )


def sessions(spark, sf, mode="equal"):
    return ss.build_sessions(session_signals(spark, sf), v.index_bars(spark, sf), mode)


def _shown(df):
    return df.withColumn("symbols", F.array_join("symbols", ",")).select(*_SESSION_COLUMNS)


@query("sessions_equal_weight", EQUAL)
def sessions_equal_weight(spark, sf):
    return _shown(sessions(spark, sf))


@query("sessions_cap_weight", CAP)
def sessions_cap_weight(spark, sf):
    return _shown(sessions(spark, sf, "cap"))


def _upcoming_sql(raw: bool) -> str:
    avg = "abs(agg) / n" if raw else "abs(agg) / wsum"
    return f"""
      SELECT session_date, round(agg, 4) AS aggregated_signed_confidence,
        CASE WHEN agg > 0 THEN 'long' WHEN agg < 0 THEN 'short' ELSE 'flat' END AS direction,
        n AS n_contributing_events, round({avg}, 4) AS avg_confidence,
        agg <> 0 AND {avg} >= 0.8 AS actionable, contributors
      FROM (SELECT session_date, CAST(sum(CAST(enhanced_pred_sign * enhanced_confidence * w.weight
                     AS DECIMAL(28,10))) AS DOUBLE) AS agg, count(*) AS n, sum(w.weight) AS wsum,
              string_agg(p.symbol, ',' ORDER BY p.symbol) AS contributors
            FROM ({_PLACED}) p JOIN cap_weight w ON w.symbol = p.symbol GROUP BY session_date)"""


def _upcoming(spark, sf, raw):
    rows = ss.upcoming_sessions(session_signals(spark, sf), v.index_bars(spark, sf), raw=raw)
    names = F.array_join(F.transform("contributors", lambda c: c["symbol"]), ",")
    return rows.withColumn("contributors", names).drop("direction_sign")


@query("upcoming_sessions", _upcoming_sql(False))
def upcoming_sessions(spark, sf):
    return _upcoming(spark, sf, False)


@query("upcoming_sessions_raw", _upcoming_sql(True))
def upcoming_sessions_raw(spark, sf):
    return _upcoming(spark, sf, True)


@query(
    "session_bias",
    """SELECT CASE WHEN agg > 0 THEN 'long' WHEN agg < 0 THEN 'short' ELSE 'flat' END AS direction,
         CAST(sign(agg) AS INTEGER) AS direction_sign, round(agg, 4) AS aggregated_signed_confidence,
         round(abs(agg) / wsum, 4) AS avg_confidence, n AS n_contributors,
         agg <> 0 AND abs(agg) / wsum >= 0.8 AS actionable
       FROM (SELECT CAST(sum(CAST(enhanced_pred_sign * enhanced_confidence * w.weight
                    AS DECIMAL(28,10))) AS DOUBLE) AS agg, count(*) AS n, sum(w.weight) AS wsum
             FROM signals s JOIN cap_weight w ON w.symbol = s.symbol WHERE enhanced_pred_sign <> 0)""",
)
def session_bias(spark, sf):
    return ss.session_bias(session_signals(spark, sf))


def _overlay_sql(rows: str) -> str:
    r_, c_ = "directional_return_pct", "(directional_return_pct - 0.02)"
    return f"""
      SELECT count(*) AS trades, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate,
        count(*) FILTER (direction > 0) AS long_trades, count(*) FILTER (direction < 0) AS short_trades,
        round(avg(session_return_pct) FILTER (direction > 0), 4) AS mean_session_return_long_pct,
        round(avg(session_return_pct) FILTER (direction < 0), 4) AS mean_session_return_short_pct,
        round(avg({r_}), 4) AS directional_return_pct_mean,
        round((product(1 + {r_} / 100.0) - 1) * 100.0, 4) AS directional_return_pct_cum,
        round(avg({r_}) / stddev_samp({r_}) * sqrt(252.0), 4) AS sharpe_annualized,
        (SELECT round(min((equity - peak) / peak * 100.0), 4) FROM (
           SELECT equity, max(equity) OVER (ORDER BY session_date) AS peak FROM (
             SELECT session_date, product(1 + {r_} / 100.0) OVER (ORDER BY session_date) AS equity
             FROM ({rows})))) AS max_drawdown_pct,
        0.02 AS round_trip_cost_pct,
        round(count(*) FILTER ({c_} > 0) / count(*), 4) AS after_cost_hit_rate,
        round(avg({c_}), 4) AS after_cost_mean_pct,
        round((product(1 + {c_} / 100.0) - 1) * 100.0, 4) AS after_cost_cum_pct,
        round(avg({c_}) / stddev_samp({c_}) * sqrt(252.0), 4) AS after_cost_sharpe
      FROM ({rows})"""


@query("overlay_metrics", _overlay_sql(EQUAL))
def overlay_metrics(spark, sf):
    return ss.overlay_metrics(cut_lineage(sessions(spark, sf)))


@query(
    "session_metrics",
    f"""SELECT count(*) AS trades, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate,
          round(avg(directional_return_pct), 4) AS mean_directional_return_pct,
          round((product(1 + directional_return_pct / 100.0) - 1) * 100.0, 4) AS cumulative_return_pct,
          round(avg(directional_return_pct) / stddev_samp(directional_return_pct) * sqrt(252.0), 4)
            AS sharpe_annualized,
          (SELECT round(least(0, min((equity - peak) / peak * 100.0)), 4) FROM (
             SELECT equity, greatest(1.0, max(equity) OVER (ORDER BY session_date)) AS peak FROM (
               SELECT session_date, product(1 + (directional_return_pct - 0.1) / 100.0)
                 OVER (ORDER BY session_date) AS equity FROM ({CAP})))) AS max_drawdown_pct,
          round((product(1 + (directional_return_pct - 0.1) / 100.0) - 1) * 100.0, 4)
            AS after_cost_cumulative_pct
        FROM ({CAP})""",
)
def session_metrics(spark, sf):
    return ss.session_metrics(cut_lineage(sessions(spark, sf, "cap")))


@query(
    "by_confidence_bucket",
    f"""SELECT ord, t.bucket, count(s.hit) AS trades,
          round(count(*) FILTER (s.hit) / nullif(count(s.hit), 0), 4) AS hit_rate,
          round(avg(s.directional_return_pct), 4) AS directional_return_pct_mean
        FROM (VALUES (0, '0.50-0.55'), (1, '0.55-0.60'), (2, '0.60-0.70'), (3, '0.70-0.80'),
                     (4, '>=0.80')) t(ord, bucket)
        LEFT JOIN ({EQUAL}) s ON s.confidence_bucket = t.bucket GROUP BY ord, t.bucket""",
)
def by_confidence_bucket(spark, sf):
    return ss.by_confidence_bucket(sessions(spark, sf))


@query(
    "filtered_signals",
    """SELECT symbol, t_event, enhanced_confidence,
         CASE WHEN enhanced_confidence < 0.5 THEN 0 ELSE enhanced_pred_sign END AS enhanced_pred_sign
       FROM signals WHERE symbol IN (SELECT symbol FROM company WHERE sector IN (
         SELECT 'N' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey IN (1, 2)))""",
)
def filtered_signals(spark, sf):
    nations = v.table(spark, sf, "nation").where(F.col("n_regionkey").isin(1, 2))
    members = v.company(spark, sf).join(
        nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("sector")),
        "sector",
        "left_semi",
    )
    kept = ss.filter_signals(signalled(spark, sf), members, min_confidence=0.5)
    return kept.select("symbol", "t_event", "enhanced_confidence", "enhanced_pred_sign")


@query(
    "session_plans",
    f"""SELECT symbol, d, side AS direction_sign, {shortest('stop')} AS stop_price,
         {shortest('target')} AS target_price, {shortest('abs(entry - stop) / entry * 100.0')} AS stop_pct,
         {shortest('abs(target - entry) / entry * 100.0')} AS target_pct
       FROM (
         SELECT *, CASE WHEN side > 0 THEN least(entry * (1 - sp / 100.0),
                          CASE WHEN pdl <> 0 AND pdl < entry THEN pdl * 0.999e0 END)
                     ELSE greatest(entry * (1 + sp / 100.0),
                          CASE WHEN pdh <> 0 AND pdh > entry THEN pdh * 1.001e0 END) END AS stop,
              CASE WHEN side > 0 THEN greatest(entry * (1 + tp / 100.0),
                          CASE WHEN pdh <> 0 AND pdh > entry THEN pdh END)
                     ELSE least(entry * (1 - tp / 100.0),
                          CASE WHEN pdl <> 0 AND pdl < entry THEN pdl END) END AS target
         FROM (
           SELECT *, round(2 * sp, 4) AS tp FROM (
             SELECT symbol, d, entry, pdh, pdl, side,
               round(greatest(0.35, least(2.5, 0.65 * CASE WHEN atr > 0 THEN atr ELSE 1.2 END)), 4) AS sp
             FROM (
               SELECT symbol, d, close AS entry, CASE WHEN close >= open THEN 1 ELSE -1 END AS side,
                 lag(high) OVER w AS pdh, lag(low) OVER w AS pdl,
                 CASE WHEN row_number() OVER w >= 15 AND close > 0 THEN avg(tr) OVER (
                   PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING) / close * 100.0 END AS atr
               FROM (SELECT *, greatest(abs(high - low), coalesce(abs(high - lag(close) OVER w), 0),
                              coalesce(abs(low - lag(close) OVER w), 0)) AS tr
                     FROM tick_bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
               WINDOW w AS (PARTITION BY symbol ORDER BY d))
             WHERE entry > 0)))""",
)
def session_plans(spark, sf):
    rows = mk.structure_features(v.tick_bars(spark, sf)).withColumns(
        {
            "entry": F.col("close"),
            "direction_sign": F.when(F.col("close") >= F.col("open"), 1).otherwise(-1),
        }
    )
    return ss.session_plan(rows.where(F.col("entry") > 0)).select(
        "symbol", "d", "direction_sign", "stop_price", "target_price", "stop_pct", "target_pct"
    )

