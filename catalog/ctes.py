"""The views of ``catalog.views`` in DuckDB SQL, by name, in dependency order."""

from catalog import views as v

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"


def symbol(key: str) -> str:
    return f"'S' || lpad(CAST({key} AS VARCHAR), 8, '0')"


def whole_word(text: str, term: str) -> str:
    """Whether ``text`` holds ``term`` (an SQL expression) as whole words."""
    return f"regexp_matches({text}, '(^|{NOT_W})' || {term} || '({NOT_W}|$)')"


def occurrences(low: str, terms) -> str:
    """Summed non-overlapping substring occurrences."""
    return " + ".join(
        f"(length({low}) - length(replace({low}, '{t}', ''))) // {len(t)}" for t in terms
    )


def phrase_hits(text: str, patterns) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in patterns)


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


def shortest(expr: str, digits: int = 4) -> str:
    """Round half up on the shortest decimal form of a double.

    ``round`` multiplies first and can push a value below a tie onto it; short
    decimals divided by 20 hit ties often.
    """
    return f"CAST(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(30,{digits})) AS DOUBLE)"


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> 0 THEN (({b}) - ({a})) / ({a}) * 100.0 END"


def sign(x: str, dz: float) -> str:
    return f"CASE WHEN {x} > {dz} THEN 1 WHEN {x} < -{dz} THEN -1 WHEN {x} IS NOT NULL THEN 0 END"


_UNIT = "l_extendedprice / l_quantity"
_CLOSE = (
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE)"
    " / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)"
)
_OVER = "OVER (PARTITION BY symbol ORDER BY d)"


def _nth(key: str, values) -> str:
    listed = ", ".join(f"'{x}'" for x in values)
    return f"list_extract([{listed}], CAST({key} % {len(values)} AS INTEGER) + 1)"


_URL = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _compact(text: str) -> str:
    return f"trim(regexp_replace({text}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


VIEWS = {
    "bars": f"""
        SELECT symbol, d, (high + low) / 2 AS open, high, low, close FROM (
          SELECT {symbol('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS d,
                 max({_UNIT}) AS high, min({_UNIT}) AS low, {_CLOSE} AS close
          FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))""",
    "index_bars": f"""
        SELECT d, (high + low) / 2 AS open, high, low, close FROM (
          SELECT CAST(l_shipdate AS DATE) AS d,
                 max({_UNIT}) AS high, min({_UNIT}) AS low, {_CLOSE} AS close
          FROM lineitem GROUP BY CAST(l_shipdate AS DATE))""",
    "earnings": f"""
        SELECT {symbol('l_suppkey')} AS symbol, min(l_shipdate) AS t_event
        FROM lineitem GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)""",
    "earnings_shifted": """
        SELECT symbol, t_event + INTERVAL 36 HOURS AS t_event FROM earnings""",
    "company": f"""
        SELECT {symbol('s_suppkey')} AS symbol, s_name AS name,
               'N' || CAST(s_nationkey AS VARCHAR) AS sector FROM supplier""",
    "edges": f"""
        SELECT src, dst, max(weight) AS weight, min(hop) AS place FROM (
          SELECT {symbol('s_suppkey')} AS src,
                 {symbol('(s_suppkey + hop) % (SELECT count(*) FROM supplier)')} AS dst, weight, hop
          FROM supplier, (VALUES (1, CAST(0.9 AS DOUBLE)), (7, CAST(0.6 AS DOUBLE))) h(hop, weight))
        WHERE src <> dst GROUP BY src, dst""",
    "graph": f"""
        SELECT src, dst, weight, true AS is_peer FROM edges
        UNION ALL SELECT src, dst, CAST(0.3 AS DOUBLE), false FROM (
          SELECT {symbol('s_suppkey')} AS src,
                 {symbol('(s_suppkey + 4) % (SELECT count(*) FROM supplier)')} AS dst FROM supplier)
        WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM edges)""",
    "hedges": """
        SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS sector, r_name AS hedge
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "cap_weight": f"""
        SELECT {symbol('s_suppkey')} AS symbol,
               CAST(CAST(s_acctbal AS DECIMAL(14,2)) + 2000 AS DOUBLE)
               / (SELECT CAST(sum(CAST(s_acctbal AS DECIMAL(14,2)) + 2000) AS DOUBLE)
                  FROM supplier) AS weight
        FROM supplier""",
    "news": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id,
               'https://' || source || '.example.com/n/' || CAST(doc_id AS VARCHAR) AS url,
               TIMESTAMP '1995-01-02 00:00:00' + to_days(CAST(doc_id * 37 % 2500 AS INTEGER))
                 + to_hours(doc_id % 24) AS doc_ts,
               source, source || '.example.com' AS source_domain,
               split_part(text, chr(10), 1) AS title, text AS body, lang,
               (doc_id % 50) / 10.0 AS relevance_score
        FROM documents""",
    "entities": f"""
        SELECT {symbol('s_suppkey')} AS symbol, {_nth('s_suppkey', v.TICKERS)} AS ticker,
               {_nth('s_suppkey', v.NAMES)} AS name FROM supplier""",
    "encoder_scores": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, quality * 0.5 - toxic * 0.75 AS score
        FROM labels""",
    "trades": f"""
        SELECT o_orderpriority AS strategy, o_orderdate AS t_event,
               {symbol('o_orderkey')} AS symbol, o_orderkey AS trade_key,
               (CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) % 1000) / 100.0 - 5
                 AS actual_5d_return_pct,
               (o_orderkey % 100) / 100.0 AS conf,
               CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS sign
        FROM orders""",
    "ticks": """
        SELECT CAST(user_id AS VARCHAR) AS symbol, ts, value AS price FROM events""",
    "tick_bars": """
        SELECT symbol, CAST(ts AS DATE) AS d, min_by(price, ts) AS open, max(price) AS high,
               min(price) AS low, max_by(price, ts) AS close
        FROM ticks GROUP BY symbol, CAST(ts AS DATE)""",
    "journal": """
        SELECT 'A' || CAST(o_custkey AS VARCHAR) AS account, o_orderkey AS trade_id,
               CAST(o_orderdate AS DATE) AS day,
               CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open'
                    ELSE 'planned' END AS status,
               (CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) % 200000) / 100.0 - 900
                 AS pnl_usd
        FROM orders""",
    # Bars with everything an event reads from them; idx counts from 0.
    "bar_facts": f"""
        SELECT *, CASE WHEN idx >= 6 THEN 100.0 * stddev_samp(ret) OVER (
                    PARTITION BY symbol ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END
                  AS vol_30,
               CASE WHEN idx >= 4 THEN 100.0 * stddev_samp(ret) OVER (
                    PARTITION BY symbol ORDER BY d ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)
                    ELSE 2.0 END AS vol_60,
               {pct('c7', 'c1')} AS pre_7, {pct('c31', 'c1')} AS pre_30,
               {pct('c61', 'c1')} AS pre_60, {pct('c5', 'close')} AS last_5,
               {pct('close', 'n5')} AS post_5
        FROM (SELECT *, row_number() {_OVER} - 1 AS idx,
                (close - lag(close) {_OVER}) / lag(close) {_OVER} AS ret,
                coalesce(lag(close, 1) {_OVER}, first(close) {_OVER}) AS c1,
                coalesce(lag(close, 5) {_OVER}, first(close) {_OVER}) AS c5,
                coalesce(lag(close, 7) {_OVER}, first(close) {_OVER}) AS c7,
                coalesce(lag(close, 31) {_OVER}, first(close) {_OVER}) AS c31,
                coalesce(lag(close, 61) {_OVER}, first(close) {_OVER}) AS c61,
                lead(close, 5) {_OVER} AS n5
              FROM bars)""",
    # Labelled events: the first bar on or after the date of T.
    "ev": f"""
        SELECT e.symbol, e.t_event, b.idx, round(b.post_5, 4) AS actual_5d_return_pct,
               {sign('b.post_5', 0.15)} AS actual_sign,
               round(b.pre_7, 4) AS baseline_pre_7d_return_pct,
               {sign('b.pre_7', 0.1)} AS baseline_pred_sign
        FROM earnings_shifted e ASOF JOIN bar_facts b
          ON e.symbol = b.symbol AND CAST(e.t_event AS DATE) <= b.d
        WHERE b.pre_7 IS NOT NULL AND b.post_5 IS NOT NULL""",
    # Events with a heuristic signal that needs no news.
    "signals": f"""
        SELECT symbol, t_event, actual_5d_return_pct, actual_sign, baseline_pre_7d_return_pct,
               baseline_pred_sign,
               CASE WHEN baseline_pre_7d_return_pct > 0 THEN -1
                    WHEN baseline_pre_7d_return_pct < 0 THEN 1 ELSE 0 END AS enhanced_pred_sign,
               {shortest("least(1e0, 15e-2 + abs(baseline_pre_7d_return_pct) / 12e1)")}
                 AS enhanced_confidence
        FROM ev""",
    "raw_urls": """
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN url
          WHEN 1 THEN bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END
               || 'utm_source=a&q=&FBCLID=b&flag#frag'
          ELSE replace(replace(url, 'https://', '  HTTPS://WWW.'), 'http://', 'Http://www.') END AS raw_url
        FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages)""",
    "clean_urls": f"""
        SELECT page_id, raw_url, scheme || '://' || host || path
                 || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url,
               regexp_replace(host, '^www[.]', '') AS domain
        FROM (SELECT page_id, raw_url, lower(regexp_extract(u, '{_URL}', 1)) AS scheme,
                lower(regexp_extract(u, '{_URL}', 2)) AS host, regexp_extract(u, '{_URL}', 3) AS path,
                array_to_string(list_transform(list_filter(
                  string_split(regexp_extract(u, '{_URL}', 4), '&'),
                  lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|igshid)(=|$)')),
                  lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS q
              FROM (SELECT *, trim(raw_url) AS u FROM raw_urls))""",
    "compact_news": f"""
        SELECT doc_id, doc_ts, source, source_domain, relevance_score, lang, title, body, url,
               {_compact("title")} AS ctitle, {_compact("body")} AS cbody
        FROM news""",
    "doc_facts": f"""
        SELECT n.doc_id, n.doc_ts, trim(n.title) AS title, n.relevance_score, n.pos, n.neg,
               CASE WHEN n.pos + n.neg > 0 THEN (n.pos - n.neg) / (n.pos + n.neg) ELSE 0.0 END AS lex,
               n.pos_hits, n.neg_hits, s.score AS enc
        FROM (SELECT *, {occurrences("lower(txt)", v.POSITIVE)} AS pos,
                     {occurrences("lower(txt)", v.NEGATIVE)} AS neg,
                     {phrase_hits("txt", v.GOOD_PHRASES)} AS pos_hits,
                     {phrase_hits("txt", v.BAD_PHRASES)} AS neg_hits
              FROM (SELECT *, title || ' ' || body AS txt FROM news)) n
        LEFT JOIN encoder_scores s ON s.doc_id = n.doc_id""",
    "named": f"""
        SELECT doc_id, alias, max(by_ticker) AS by_ticker FROM (
          SELECT d.doc_id, a.alias, d.by_ticker
          FROM (SELECT DISTINCT ticker || '|' || name AS alias, ticker, name FROM entities) a
          JOIN ({" UNION ALL ".join(
              f"SELECT doc_id, '{t}' AS term, 1 AS by_ticker FROM news WHERE "
              + whole_word("(title || ' ' || body)", f"'{t}'") for t in v.TICKERS)}
            UNION ALL {" UNION ALL ".join(
              f"SELECT doc_id, '{t}' AS term, 0 AS by_ticker FROM news WHERE "
              + whole_word("lower(title || ' ' || body)", f"'{t}'") for t in v.NAMES)}) d
            ON (d.by_ticker = 1 AND d.term = a.ticker) OR (d.by_ticker = 0 AND d.term = a.name))
        GROUP BY doc_id, alias""",
}
