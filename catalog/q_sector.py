"""Sector outlook, annual study and trade journal."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.ctes import pct, r
from tidemark import fixed_values as fx
from tidemark.operators import annual as an
from tidemark.operators import journal as jn
from tidemark.operators import sector as sc
from tidemark.operators.documents import latest
from tidemark.session import cut_lineage

SECTOR = "N3"
KEYWORDS = {
    f"N{k}": (v.TICKERS[k % len(v.TICKERS)], v.NAMES[k % len(v.NAMES)]) for k in range(25)
}


def _present(low: str, terms) -> str:
    return " + ".join(f"CAST(contains({low}, '{t}') AS INTEGER)" for t in terms)


def _nth(key: str, values) -> str:
    listed = ", ".join(f"'{x}'" for x in values)
    return f"list_extract([{listed}], CAST({key} % {len(values)} AS INTEGER) + 1)"


_LOW = f"""
    SELECT doc_id, doc_ts, lower(title || ' ' || body) AS low,
      ({_present("lower(title || ' ' || body)", v.POSITIVE)})
        - ({_present("lower(title || ' ' || body)", v.NEGATIVE)}) AS sentiment FROM news"""

_BASES = f"""
    SELECT doc_id, doc_ts, low, sector,
      1.2e0 * (CAST(contains(low, term) AS INTEGER) + CAST(contains(low, name) AS INTEGER)) + sentiment AS base
    FROM ({_LOW}), (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS sector,
      {_nth('n_nationkey', v.TICKERS)} AS term, {_nth('n_nationkey', v.NAMES)} AS name FROM nation)"""


@query("sector_document_scores", f"SELECT doc_id, sector, {r('base')} AS base FROM ({_BASES})")
def sector_document_scores(spark, sf):
    scores = sc.sector_doc_scores(v.news(spark, sf), KEYWORDS, v.POSITIVE, v.NEGATIVE)
    return scores.select("doc_id", "sector", F.round("base", 6).alias("base"))


def _outlook_sql(sector: str) -> str:
    return f"""
      SELECT c.symbol, c.sector, p.close AS current_price, mv AS move, round(mv, 2) AS predicted_move_pct,
        CASE WHEN mv > 0.05 THEN 'up' WHEN mv < -0.05 THEN 'down' ELSE 'flat' END AS predicted_direction,
        CASE WHEN mv >= 0 THEN 'Leverage' ELSE 'Hedge' END AS leverage_or_hedge,
        round(c.corr, 3) AS correlation_to_sector, coalesce(d.n, 0) AS neighbours,
        coalesce(d.nearest, (SELECT min(symbol) FROM company f WHERE f.sector = c.sector)) AS connected_to,
        c.mentions_7d
      FROM (
        SELECT m.symbol, m.sector, m.mentions_7d, coalesce(k.corr, 0) AS corr,
          greatest(-12.0, least(12.0, 0.45 * coalesce(m.pressure, 0) + 0.35 * m.history
            + 1.1 * coalesce(k.corr, 0))) AS mv
        FROM (
          SELECT t.symbol, t.sector, avg(s) AS history,
            avg(s) FILTER (recent AND s <> 0) AS pressure,
            count(*) FILTER (recent AND hit) AS mentions_7d
          FROM (
            SELECT e.symbol, x.sector, x.base + CASE WHEN contains(x.low, e.ticker)
                OR contains(x.low, e.name) THEN 1 ELSE 0 END AS s,
              contains(x.low, e.ticker) OR contains(x.low, e.name) AS hit,
              x.doc_ts >= TIMESTAMP '{v.AS_OF} 00:00:00' - INTERVAL 7 DAYS AS recent
            FROM (SELECT e.symbol, e.ticker, e.name, {sector} AS sector
                  FROM entities e JOIN company c ON c.symbol = e.symbol) e
            JOIN ({_BASES}) x ON x.sector = e.sector
            WHERE x.doc_ts BETWEEN TIMESTAMP '{v.AS_OF} 00:00:00' - INTERVAL 1825 DAYS
              AND TIMESTAMP '{v.AS_OF} 00:00:00') t
          GROUP BY t.symbol, t.sector) m
        LEFT JOIN (
          SELECT symbol, corr(x, peer) AS corr FROM (
            SELECT a.symbol, a.d, a.x, avg(b.x) AS peer
            FROM (SELECT z.*, {sector} AS sector FROM (
                    SELECT symbol, d, 100.0 * ret AS x FROM bar_facts
                    WHERE ret IS NOT NULL AND d <= DATE '{v.AS_OF}'
                    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 252) z
                  JOIN company c ON c.symbol = z.symbol) a
            JOIN (SELECT f.symbol, f.d, 100.0 * f.ret AS x, c.sector
                  FROM bar_facts f JOIN company c ON c.symbol = f.symbol WHERE f.ret IS NOT NULL) b
              ON b.sector = a.sector AND b.d = a.d AND b.symbol <> a.symbol
            GROUP BY a.symbol, a.d, a.x) GROUP BY symbol) k ON k.symbol = m.symbol) c
      LEFT JOIN (SELECT symbol, max_by(close, d) AS close FROM bars WHERE d <= DATE '{v.AS_OF}'
                 GROUP BY symbol) p ON p.symbol = c.symbol
      LEFT JOIN (SELECT src, count(*) AS n, min_by(dst, place) AS nearest FROM edges GROUP BY src) d ON d.src = c.symbol"""


IN_SECTOR = _outlook_sql(f"'{SECTOR}'")
NATIVE = _outlook_sql("c.sector")
_SHOWN = """symbol, sector, current_price, predicted_move_pct,
  predicted_direction, leverage_or_hedge, correlation_to_sector, neighbours, connected_to, mentions_7d"""
_SHOWN_COLUMNS = (
    "symbol", "sector", "current_price", "predicted_move_pct", "predicted_direction",
    "leverage_or_hedge", "correlation_to_sector", "neighbours", "connected_to", "mentions_7d",
)


def outlook(spark, sf, sector=None):
    found = v.entities(spark, sf)
    terms = found.select("symbol", F.col("ticker").alias("term")).unionByName(
        found.select("symbol", F.col("name").alias("term"))
    )
    return sc.symbol_outlook(
        v.news(spark, sf),
        v.bars(spark, sf),
        v.company(spark, sf),
        terms,
        v.edges(spark, sf),
        v.AS_OF,
        sector,
        KEYWORDS,
        v.POSITIVE,
        v.NEGATIVE,
    )


def _shown(df):
    return df.select(*_SHOWN_COLUMNS)


@query("sector_outlook", f"SELECT {_SHOWN} FROM ({IN_SECTOR})")
def sector_outlook(spark, sf):
    return _shown(outlook(spark, sf, SECTOR))


@query("universe_outlook", f"SELECT {_SHOWN} FROM ({NATIVE})")
def universe_outlook(spark, sf):
    return _shown(outlook(spark, sf))


_STRONGEST = "ORDER BY abs(predicted_move_pct) DESC, symbol"


@query(
    "sector_summary",
    f"""SELECT metric_a, metric_b, metric_c, metric_d, '{SECTOR}' AS sector, hits AS news_articles_7d,
          round(greatest(-12.0, least(12.0, 0.55 * metric_a + 2.0 * mean + 0.75 * metric_b)), 2)
            AS predicted_sector_move_pct,
          round(greatest(5.0, least(95.0, 30.0 + least(40, hits) * 1.1 + metric_b * 20.0)), 1) AS confidence
        FROM (SELECT round(sum(abs(predicted_move_pct)) / 5.0, 2) AS metric_a,
                round(sum(abs(correlation_to_sector)) / 5.0, 3) AS metric_b,
                round(sum(greatest(0, predicted_move_pct)) / 5.0, 2) AS metric_c,
                round(sum(neighbours) / 5.0, 2) AS metric_d
              FROM (SELECT * FROM ({IN_SECTOR}) {_STRONGEST} LIMIT 5)),
          (SELECT CAST(sum(mentions_7d) AS BIGINT) AS hits FROM ({IN_SECTOR})),
          (SELECT avg(100.0 * ret) AS mean FROM bar_facts f JOIN company c ON c.symbol = f.symbol
           WHERE c.sector = '{SECTOR}' AND d <= DATE '{v.AS_OF}')""",
)
def sector_summary(spark, sf):
    rows = cut_lineage(outlook(spark, sf, SECTOR))
    return sc.sector_summary(rows, v.bars(spark, sf), v.company(spark, sf), SECTOR, v.AS_OF)


_OWNED = "(SELECT symbol FROM company WHERE sector IN ('N3', 'N7'))"


@query(
    "sector_picks",
    f"""SELECT symbol, predicted_move_pct, true AS owned FROM (
          SELECT * FROM ({IN_SECTOR}) WHERE symbol IN {_OWNED} {_STRONGEST} LIMIT 3)
        UNION ALL SELECT symbol, predicted_move_pct, false FROM (
          SELECT * FROM ({IN_SECTOR}) WHERE symbol NOT IN {_OWNED} {_STRONGEST} LIMIT 5)""",
)
def sector_picks(spark, sf):
    owned = v.company(spark, sf).where(F.col("sector").isin("N3", "N7"))
    picks = sc.sector_picks(cut_lineage(outlook(spark, sf, SECTOR)), owned)
    return picks.select("symbol", "predicted_move_pct", "owned")


@query(
    "universe_summary",
    f"""SELECT sector, round(avg(move), 2) AS predicted_move_pct, count(*) AS stock_count
        FROM ({NATIVE}) GROUP BY sector""",
)
def universe_summary(spark, sf):
    return sc.universe_summary(outlook(spark, sf))


@query(
    "universe_confidence",
    f"""SELECT round(greatest(5.0, least(95.0, 30.0 + least(40, hits) * 1.1 + c * 20.0)), 1) AS confidence,
          hits AS news_articles_7d
        FROM (SELECT avg(abs(correlation_to_sector)) AS c
              FROM (SELECT * FROM ({NATIVE}) {_STRONGEST} LIMIT 5)),
             (SELECT CAST(sum(mentions_7d) AS BIGINT) AS hits FROM ({NATIVE}))""",
)
def universe_confidence(spark, sf):
    return sc.universe_confidence(cut_lineage(outlook(spark, sf)))


# --- annual study ------------------------------------------------------------

YEARS = 4
_ANCHORS = f"""
    SELECT symbol, year(t_event) AS event_year, max(t_event) AS anchor FROM earnings_shifted
    GROUP BY symbol, year(t_event)
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year(t_event) DESC) <= {YEARS}"""


def anchors(spark, sf):
    return an.annual_anchors(v.earnings_shifted(spark, sf), YEARS)


@query("annual_anchors", _ANCHORS)
def annual_anchors(spark, sf):
    return anchors(spark, sf)


_ANCHOR_RETURNS = f"""
    SELECT a.symbol || '_' || CAST(CAST(a.anchor AS DATE) AS VARCHAR) AS event_id, a.symbol,
      a.event_year, CAST(a.anchor AS DATE) AS anchor_date,
      CAST(a.anchor AS DATE) - 30 AS pre_window_start, CAST(a.anchor AS DATE) + 20 AS post_window_end,
      CASE WHEN usable THEN round({pct('p0', 'pa')}, 4) END AS pre_return_pct,
      CASE WHEN usable THEN round({pct('pa', 'p5')}, 4) END AS post_return_pct,
      CAST(CASE WHEN usable THEN sign(p5 - pa) ELSE 0 END AS INTEGER) AS target_sign
    FROM (
      SELECT a.*, x.close AS p0, y.close AS pa, z.close AS p5,
        coalesce(z.d <= CAST(a.anchor AS DATE) + 27, false) AS usable
      FROM ({_ANCHORS}) a
      ASOF LEFT JOIN bars x ON x.symbol = a.symbol AND CAST(a.anchor AS DATE) - 30 <= x.d
      ASOF LEFT JOIN bars y ON y.symbol = a.symbol AND CAST(a.anchor AS DATE) <= y.d
      ASOF LEFT JOIN bars z ON z.symbol = a.symbol AND CAST(a.anchor AS DATE) + 20 <= z.d) a"""


@query("anchor_returns", _ANCHOR_RETURNS)
def anchor_returns(spark, sf):
    return an.anchor_returns(anchors(spark, sf), v.bars(spark, sf)).drop("anchor")


def _articles(spark, sf):
    """Each document as an article of the symbol that its number points at."""
    n = v.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    return v.news(spark, sf).select(
        v.symbol_of(F.pmod(F.col("doc_id").cast("bigint"), n)).alias("symbol"),
        "doc_id",
        "doc_ts",
        "title",
        "body",
    )


TANH_AI = ("thatin", "of the", "ertion")
_NEWS = f"""
    SELECT e.event_id, e.symbol, s.score, s.ai FROM ({_ANCHOR_RETURNS}) e JOIN (
      SELECT symbol, doc_id, doc_ts, ai, round(tanh((pos - neg + 0.35 * ai) / 4.5), 6) AS score
      FROM (SELECT 'S' || lpad(CAST(CAST(doc_id AS BIGINT) % (SELECT count(*) FROM supplier) AS VARCHAR),
                8, '0') AS symbol, doc_id, doc_ts, {_present('low', v.POSITIVE)} AS pos,
              {_present('low', v.NEGATIVE)} AS neg, {_present('low', TANH_AI)} AS ai
            FROM (SELECT doc_id, doc_ts, trim(regexp_replace(lower(title || ' ' || body),
                    '[\\s\\p{{Z}}]+', ' ', 'g')) AS low FROM news))) s
      ON s.symbol = e.symbol AND CAST(s.doc_ts AS DATE) BETWEEN e.pre_window_start AND e.anchor_date
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY s.doc_ts DESC, s.doc_id) <= 25"""
_EVENTS = f"""
    SELECT e.*, coalesce(n.news_count, 0) AS news_count,
      round(coalesce(n.mean, 0), 6) AS mean_sentiment, coalesce(n.ai, 0) AS ai_term_hits
    FROM ({_ANCHOR_RETURNS}) e LEFT JOIN (
      SELECT event_id, count(*) AS news_count, avg(score) AS mean, CAST(sum(ai) AS BIGINT) AS ai
      FROM ({_NEWS}) GROUP BY event_id) n ON n.event_id = e.event_id"""


def annual(spark, sf):
    returns = cut_lineage(an.anchor_returns(anchors(spark, sf), v.bars(spark, sf)))
    news = an.anchor_news(
        returns, _articles(spark, sf), 30, 25, v.POSITIVE, v.NEGATIVE, TANH_AI
    )
    return an.annual_events(returns, news)


@query("annual_events", _EVENTS)
def annual_events(spark, sf):
    return annual(spark, sf)


_SPILL = f"""
    SELECT e.event_id, e.symbol AS source_symbol, d.dst AS target_symbol, d.weight AS edge_weight,
      round(e.mean_sentiment * d.weight, 6) AS spillover_score
    FROM ({_EVENTS}) e JOIN edges d ON d.src = e.symbol"""


@query("spillover_effects", _SPILL)
def spillover_effects(spark, sf):
    return an.spillover_effects(annual(spark, sf), v.edges(spark, sf))


@query(
    "strongest_spillovers",
    f"""SELECT event_id, target_symbol, spillover_score FROM ({_SPILL})
        ORDER BY abs(spillover_score) DESC, event_id, target_symbol LIMIT 200""",
)
def strongest_spillovers(spark, sf):
    effects = an.spillover_effects(annual(spark, sf), v.edges(spark, sf))
    order = [F.abs("spillover_score").desc(), F.col("event_id"), F.col("target_symbol")]
    rows = effects.select("event_id", "target_symbol", "spillover_score")
    return latest(rows, order, 200, most=2000)


@query(
    "latest_annual_events",
    f"""SELECT event_id, anchor_date, symbol FROM ({_ANCHOR_RETURNS})
        ORDER BY anchor_date DESC, symbol LIMIT 100""",
)
def latest_annual_events(spark, sf):
    rows = an.anchor_returns(anchors(spark, sf), v.bars(spark, sf))
    order = [F.col("anchor_date").desc(), F.col("symbol")]
    return latest(rows.select("event_id", "anchor_date", "symbol"), order, 100, most=1000)


# --- journal -----------------------------------------------------------------

_STATS = """
    count(*) AS trades_total, count(*) FILTER (status = 'closed') AS trades_closed,
    count(*) FILTER (status = 'open') AS trades_open,
    count(*) FILTER (status = 'planned') AS trades_planned,
    round(count(*) FILTER (status = 'closed' AND pnl_usd > 0)
      / nullif(count(*) FILTER (status = 'closed'), 0), 4) AS win_rate,
    round(coalesce(sum(pnl_usd) FILTER (status = 'closed'), 0), 2) AS total_pnl_usd,
    round(avg(pnl_usd) FILTER (status = 'closed' AND pnl_usd > 0), 2) AS avg_win_usd,
    round(avg(pnl_usd) FILTER (status = 'closed' AND pnl_usd < 0), 2) AS avg_loss_usd,
    CASE WHEN sum(pnl_usd) FILTER (status = 'closed' AND pnl_usd < 0) <> 0 THEN
      round(coalesce(sum(pnl_usd) FILTER (status = 'closed' AND pnl_usd > 0), 0)
        / abs(sum(pnl_usd) FILTER (status = 'closed' AND pnl_usd < 0)), 2) END AS profit_factor"""


@query("journal_stats", f"SELECT {_STATS} FROM journal")
def journal_stats(spark, sf):
    return jn.journal_stats(v.journal(spark, sf))


@query(
    "open_journal_trades",
    """SELECT trade_id, account, day FROM journal WHERE status = 'open'
       ORDER BY day DESC, trade_id DESC LIMIT 100""",
)
def open_journal_trades(spark, sf):
    rows = v.journal(spark, sf).where(F.col("status") == "open").select("trade_id", "account", "day")
    return latest(rows, [F.col("day").desc(), F.col("trade_id").desc()], 100, most=500)


_PRESETS = ", ".join(f"('{n}', {s}, {t}, {g})" for n, s, t, g in fx.ACCOUNT_PRESETS)


@query(
    "account_state",
    f"""SELECT account, day, preset, round(balance, 2) AS current_balance,
          round(peak, 2) AS peak_eod_balance, round(todays_pnl, 2) AS todays_pnl,
          round(floor, 2) AS trailing_floor, round(balance - floor, 2) AS buffer_remaining,
          round(start + target - balance, 2) AS distance_to_target, peak >= start AS is_locked_floor,
          balance - floor < 200 AS kill_switch_active,
          CASE WHEN balance - floor <= 0 THEN 'breached' WHEN balance - floor < 200 THEN 'near' END
            AS kill_switch_reason
        FROM (
          SELECT *, CASE WHEN peak >= start THEN start ELSE peak - trail END AS floor FROM (
            SELECT j.*, p.start, p.trail, p.target,
              greatest(p.start, max(balance) OVER (PARTITION BY account ORDER BY day)) AS peak
            FROM (
              SELECT account, day, CAST(pnl AS DOUBLE) AS todays_pnl,
                CASE CAST(substr(account, 2) AS BIGINT) % 3 WHEN 0 THEN '50K' WHEN 1 THEN '100K'
                     ELSE '150K' END AS preset,
                CASE CAST(substr(account, 2) AS BIGINT) % 3 WHEN 0 THEN 50000e0 WHEN 1 THEN 100000e0
                     ELSE 150000e0 END
                  + CAST(sum(pnl) OVER (PARTITION BY account ORDER BY day) AS DOUBLE) AS balance
              FROM (SELECT account, day, sum(CAST(pnl_usd AS DECIMAL(18,2))) AS pnl FROM journal
                    WHERE status = 'closed' GROUP BY account, day)) j
            JOIN (VALUES {_PRESETS}) p(preset, start, trail, target) ON p.preset = j.preset))""",
)
def account_state(spark, sf):
    presets = spark.createDataFrame(
        list(fx.ACCOUNT_PRESETS), "preset string, start double, trail double, target double"
    )
    number = F.pmod(F.substring("account", 2, 20).cast("bigint"), F.lit(3))
    preset = F.when(number == 0, "50K").when(number == 1, "100K").otherwise("150K")
    start = F.when(number == 0, 50000.0).when(number == 1, 100000.0).otherwise(150000.0)
    balances = jn.end_of_day_balances(v.journal(spark, sf), start)
    return jn.account_state(balances.withColumn("preset", preset), presets)
