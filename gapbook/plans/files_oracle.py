"""SQL for the queries of ``files``, on the same steps as the other queries."""

from __future__ import annotations

from gapbook.plans.files import MARKET
from gapbook.plans.oracle import _BLOTTER, _CODES, CAPITAL, OHLCV, _blotter, _compounded, _rounded, with_steps


def _projected(rows: str, by: str, cap: float) -> str:
    """``rows`` (``by``, symbol, v) with the nearest weights between 0 and the cap that sum to
    least(1, cap * n): sorted by v, the first k names stand at the cap and those up to j are moved by one
    t; the pair (k, j) that fits its own t is tried for, among all pairs of a book of a few names."""
    return f"""
  SELECT r.*, CASE WHEN r.i <= f.k THEN {cap} WHEN r.i <= f.j THEN r.v - f.t ELSE 0 END AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY v DESC, symbol) AS i FROM {rows}) r
  JOIN (
    SELECT {by}, min(k) AS k, arg_min(j, k) AS j, arg_min(t, k) AS t FROM (
      SELECT *, CASE WHEN j > k THEN (coalesce(s[j], 0) - CASE WHEN k > 0 THEN s[k] ELSE 0 END - (total - k * {cap})) / (j - k) END AS t
      FROM (SELECT b.*, unnest(generate_series(k, n)) AS j FROM (
        SELECT a.*, unnest(generate_series(0, n)) AS k FROM (
          SELECT {by}, count(*) AS n, least(1.0, {cap} * count(*)) AS total, list(v ORDER BY v DESC, symbol) AS vs, list(c ORDER BY v DESC, symbol) AS s
          FROM (SELECT *, sum(v) OVER (PARTITION BY {by} ORDER BY v DESC, symbol ROWS UNBOUNDED PRECEDING) AS c FROM {rows}) GROUP BY {by}) a) b))
    WHERE (j = k AND abs(total - k * {cap}) < 1e-12) OR (j > k AND vs[j] - t >= -1e-12 AND (j = n OR vs[j + 1] - t <= 1e-12) AND vs[k + 1] - t <= {cap} + 1e-12 AND (k = 0 OR vs[k] - t >= {cap} - 1e-12))
    GROUP BY {by}) f ON {" AND ".join(f"r.{x.strip()} = f.{x.strip()}" for x in by.split(","))}"""


_RATES = """
  SELECT symbol, {fees} / 10000 + {slip} / 10000 * greatest(0.25, least(4.0, v / (SELECT avg(stddev) FROM (SELECT stddev_pop({ret}) AS stddev FROM {rows} GROUP BY symbol)))) AS rate
  FROM (SELECT symbol, stddev_pop({ret}) AS v FROM {rows} GROUP BY symbol)"""


def _static(cap: float) -> str:
    """Inverse volatility over the complete set: steps up to the daily results."""
    return f"""
WITH spread AS (SELECT symbol, var_samp(ret) AS c FROM complete GROUP BY symbol),
given AS (SELECT 'Inverse Volatility' AS portfolio, symbol, 1 / sqrt(greatest(c + (SELECT greatest(avg(c) * 1e-8, 1e-10) FROM spread), 1e-12)) AS v FROM spread),
iv AS ({_projected("given", "portfolio", cap)}),
iv_rates AS ({_RATES.format(fees=1.0, slip=2.0, ret="ret", rows="complete")}),
port AS (SELECT date, sum(weight * ret) AS port FROM complete JOIN iv ON iv.symbol = complete.symbol GROUP BY date),
moves AS (SELECT c.date, port, weight, rate, CASE WHEN c.date = (SELECT min(date) FROM complete) THEN abs(weight) ELSE abs(weight * (1 + ret) / (1 + port) - weight) END AS trade
  FROM complete c JOIN iv ON iv.symbol = c.symbol JOIN iv_rates r ON r.symbol = c.symbol JOIN port p ON p.date = c.date),
iv_days AS (SELECT date, any_value(port) AS gross, sum(trade * rate) AS cost FROM moves GROUP BY date)"""


_NIGHTS = f"""
WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY overnight_sharpe DESC, symbol) AS k FROM feats
    WHERE overnight_sharpe >= 0 AND next_overnight_return IS NOT NULL AND exit_date IS NOT NULL) WHERE k <= 8),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM rets WHERE overnight_return IS NOT NULL)),
book AS (SELECT t.date, t.exit_date, t.symbol, t.overnight_sharpe, t.next_overnight_return AS r, c.pos, count(*) OVER (PARTITION BY t.date) AS n FROM top t LEFT JOIN cal c ON c.date = t.date),
past AS (SELECT b.date, b.symbol, b.n, c.pos, o.overnight_return AS x FROM book b JOIN cal c ON c.pos > b.pos - 63 AND c.pos <= b.pos JOIN rets o ON o.symbol = b.symbol AND o.date = c.date WHERE o.overnight_return IS NOT NULL),
common AS (SELECT date, pos FROM past GROUP BY date, pos HAVING count(*) = any_value(n)),
length AS (SELECT date, count(*) AS len FROM common GROUP BY date),
vars AS (SELECT p.date, p.symbol, var_samp(x) AS c FROM past p JOIN common m ON m.date = p.date AND m.pos = p.pos GROUP BY 1, 2),
jitter AS (SELECT date, greatest(avg(c) * 1e-8, 1e-10) AS j FROM vars GROUP BY date),
scored AS (SELECT b.*, coalesce(l.len, 0) < 20 AS short, CASE WHEN sum(greatest(overnight_sharpe, 0)) OVER (PARTITION BY b.date) > 0 THEN greatest(overnight_sharpe, 0) ELSE 1.0 END AS score,
    1 / sqrt(greatest(v.c + j.j, 1e-12)) AS inverse FROM book b LEFT JOIN length l ON l.date = b.date LEFT JOIN vars v ON v.date = b.date AND v.symbol = b.symbol LEFT JOIN jitter j ON j.date = b.date),
given AS (SELECT 'score_weighted' AS method, date, symbol, score AS v, false AS fallback FROM scored
  UNION ALL SELECT 'equal_weight', date, symbol, CASE WHEN short THEN score ELSE 1.0 END, short FROM scored
  UNION ALL SELECT 'inverse_volatility', date, symbol, CASE WHEN short THEN score ELSE inverse END, short FROM scored),
held AS (SELECT w.method, w.date, w.symbol, w.weight, w.fallback, b.r, n.night, n.exit_date FROM ({_projected("given", "method, date", 0.3)}) w
  JOIN book b ON b.date = w.date AND b.symbol = w.symbol JOIN (SELECT date, max(exit_date) AS exit_date, row_number() OVER (ORDER BY date) AS night FROM book GROUP BY date) n ON n.date = w.date),
old AS (SELECT method, night + 1 AS night, symbol, weight * (1 + r) / (1 + sum(weight * r) OVER (PARTITION BY method, night)) AS was FROM held),
both_nights AS (SELECT coalesce(h.method, o.method) AS method, coalesce(h.night, o.night) AS night, coalesce(h.symbol, o.symbol) AS symbol, h.weight, h.r, h.fallback, abs(coalesce(h.weight, 0) - coalesce(o.was, 0)) AS change
  FROM held h FULL JOIN old o ON o.method = h.method AND o.night = h.night AND o.symbol = h.symbol),
night_rates AS ({_RATES.format(fees=0.5, slip=1.0, ret="overnight_return", rows="rets")}),
sums AS (SELECT method, night, sum(weight * r) AS gross_return, sum(change) AS turnover, sum(change * coalesce(rate, 0)) AS cost_return, count(*) FILTER (change > 1e-9) AS trade_count,
    count(*) FILTER (abs(weight) > 1e-6) AS positions, sum(weight) AS weight_sum, coalesce(bool_or(fallback), false) AS optimizer_fallback FROM both_nights b LEFT JOIN night_rates r ON r.symbol = b.symbol GROUP BY 1, 2),
nights AS (SELECT s.*, n.date AS signal_date, n.exit_date, greatest(0, 1 - weight_sum) AS cash_weight, gross_return + greatest(0, 1 - weight_sum) * (0.02 / 252) - cost_return AS net_return, weight_sum AS gross_exposure, turnover AS round_trip_turnover
  FROM sums s JOIN (SELECT DISTINCT night, date, exit_date FROM held) n ON n.night = s.night)"""


def _uniform(what: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{MARKET.seed}|{what}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _normal(what: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(what + '/r', *keys)})) * cos(2 * pi() * {_uniform(what + '/a', *keys)}))"


def _between(what: str, low: float, high: float) -> str:
    return f"({low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * {_uniform(what, 'symbol')})"


def _market() -> str:
    key = ("symbol", "date")
    return f"""
WITH made_days AS (SELECT date, 0.00005 + 0.0045 * {_normal("market night", "date")} AS m_night, 0.006 * {_normal("market day", "date")} AS m_day
  FROM (SELECT CAST(unnest(generate_series(DATE '{MARKET.start}', DATE '{MARKET.end}', INTERVAL 1 DAY)) AS DATE) AS date) WHERE isodow(date) < 6),
made_own AS (SELECT symbol, {_between("price", MARKET.price_min, MARKET.price_max)} AS p0, {_between("volume", MARKET.volume_min, MARKET.volume_max)} AS v0, 0.0001 + 0.0001 * {_normal("mu night", "symbol")} AS mu_n,
  -0.00001 + 0.00007 * {_normal("mu day", "symbol")} AS mu_d, {_between("vol night", 0.0045, 0.0110)} AS vol_n, {_between("vol day", 0.0075, 0.0175)} AS vol_d, {_between("beta", 0.65, 1.35)} AS beta FROM (SELECT DISTINCT p_brand AS symbol FROM part)),
made AS (SELECT symbol, date, p0, v0, beta * m_night + mu_n + vol_n * {_normal("night", *key)} AS night, beta * m_day + mu_d + vol_d * {_normal("day", *key)} AS day, abs(0.006 + 0.004 * {_normal("spread", *key)}) AS spread,
  exp(0.35 * {_normal("noise", *key)}) AS noise FROM made_own, made_days),
made_priced AS (SELECT *, c * exp(-day) AS o FROM (SELECT *, p0 * exp(sum(night + day) OVER (PARTITION BY symbol ORDER BY date)) AS c FROM made))
SELECT date, symbol, round(o, 4) AS open, round(greatest(o, c) * (1 + spread), 4) AS high, round(least(o, c) * greatest(0.01, 1 - spread), 4) AS low, round(c, 4) AS close, greatest(1.0::DOUBLE, floor(v0 * noise)) AS volume FROM made_priced"""


def _queries() -> dict[str, str]:
    return {
        "bars_from_parquet": f"SELECT date, symbol, {_rounded(OHLCV, 8)} FROM bars",
        "bars_from_csv": f"SELECT date, upper(symbol) AS symbol, {_rounded(OHLCV, 8)} FROM bars WHERE dayofmonth(date) <> 13",
        "bars_quarantined": "SELECT dayofmonth(date) = 13 AS quarantined, count(*) AS lines FROM bars GROUP BY 1",
        "bars_from_vendor_json": f"SELECT date, symbol, {', '.join(f'round({c} * 0.5, 8) AS {c}' for c in ('open', 'high', 'low', 'close'))}, round(volume * 2, 8) AS volume FROM bars",
        "bars_from_vendor_csv": f"SELECT date, replace(upper(symbol), '.', '-') || '.US' AS symbol, {_rounded(OHLCV, 8)} FROM type_bars",
        "universe_from_csv": "SELECT upper(p_brand) || '-A' AS symbol, 'Maker, of ' || arg_min(p_type, p_partkey) AS name, arg_min(p_type, p_partkey) AS sector FROM part GROUP BY p_brand",
        "membership_from_csv": """
SELECT upper(m.symbol) AS symbol, a AS start_date, CASE WHEN n % 3 <> 0 THEN b END AS end_date FROM members m JOIN spells s ON s.symbol = m.symbol WHERE n % 7 <> 0""",
        "trades_reported": f"SELECT run, signal_date, exit_date, symbol, signal_rank, year(exit_date) AS year, {_rounded(_BLOTTER, 5)} FROM ({_blotter('daily', 'weight')})",
        "synthetic_market": _market(),
        "trades_exported": f"SELECT row_number() OVER (ORDER BY exit_date, signal_date, symbol, signal_rank) AS export_rank, run, signal_date, exit_date, symbol, signal_rank, {_rounded(_BLOTTER, 5)} FROM ({_blotter('daily', 'weight')})",
        "cost_own_eras": "SELECT CAST(o_orderdate AS DATE) AS signal_date, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1999-01-01' THEN 30.0::DOUBLE ELSE 7.0::DOUBLE END AS cost_rate_bps FROM orders GROUP BY 1, 2",
        "cost_model": """
SELECT 'historical' AS mode, e.era_start AS start, e.fees_bps::DOUBLE AS fees_bps, e.slippage_bps::DOUBLE AS slippage_bps, count(o.date) AS dates
FROM eras e LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) o ON o.date >= e.era_start AND (e.next_start IS NULL OR o.date < e.next_start) GROUP BY 1, 2, 3, 4""",
        "performance_with_empty_runs": f"""
SELECT run, count(*) AS observations, {CAPITAL}::DOUBLE AS initial_capital, round(arg_max(ending_equity, signal_date), 6) AS final_equity, round(arg_max(ending_equity, signal_date) / {CAPITAL} - 1, 6) AS total_return,
  round(avg(net_return) * 252 / (stddev_pop(net_return) * sqrt(252.0)), 6) AS sharpe, round(greatest((max(exit_date) - min(signal_date)) / 365.25, 1 / 252.0), 6) AS elapsed_years FROM daily GROUP BY run
UNION ALL SELECT 'idle', 0, {CAPITAL}, {CAPITAL}, NULL, NULL, 0.0""",
        "sector_listing": f"""
SELECT sector_code, count(*) FILTER (symbol IN (SELECT symbol FROM bars WHERE symbol NOT LIKE '%5')) AS priced FROM (
  SELECT p_brand AS symbol, {_CODES} AS sector_code FROM (SELECT DISTINCT p_brand, CASE WHEN p_brand LIKE '%1' THEN 'Energy' WHEN p_brand LIKE '%2' THEN 'Utilities' ELSE 'Toys' END AS sector FROM part)) GROUP BY 1""",
        "portfolio_enriched": """
SELECT portfolio, round(CASE WHEN portfolio = 'a' THEN 0.5 ELSE max(w) END, 8)::DOUBLE AS max_weight, round(sum(w), 8) AS weight_sum, round(sum(abs(w)), 8) AS gross_exposure, round(greatest(0, 1 - sum(w)), 8) AS cash_weight
FROM (SELECT DISTINCT symbol, length(symbol) / 100.0::DOUBLE AS w FROM complete), (VALUES ('a'), ('b')) AS p(portfolio) GROUP BY portfolio""",
        "inverse_volatility_summary": f"""{_static(0.3)}
SELECT 'Inverse Volatility' AS portfolio, count(*) AS observations, (SELECT count(*) FILTER (abs(weight) > 1e-6) FROM iv) AS positions, 0 AS rebalance_count, 'none' AS rebalance_frequency, NULL::DATE AS last_rebalance_date,
  '' AS optimizer_parameters, round(product(1 + gross - cost) - 1, 6) AS total_return, round(avg(gross - cost) * 252, 6) AS expected_return, round(stddev_pop(gross - cost) * sqrt(252.0), 6) AS volatility, round(sum(cost), 6) AS total_cost_return,
  round((SELECT sum(weight) FROM iv), 6) AS weight_sum, round((SELECT max(weight) FROM iv), 6) AS max_weight, round((SELECT greatest(0, 1 - sum(weight)) FROM iv), 6) AS cash_weight, 0.0::DOUBLE AS average_turnover, 0.3::DOUBLE AS max_weight_limit FROM iv_days""",
        "nightly_closed_form": f"""{_NIGHTS}
SELECT method, signal_date, exit_date, trade_count, positions, optimizer_fallback, {_rounded("gross_return, turnover, cost_return, weight_sum, cash_weight, net_return, gross_exposure, round_trip_turnover, ending_equity", 6)}
FROM ({_compounded("nights", str(CAPITAL), "method")})""",
    }


def _joined(sql: str) -> str:
    """The shared steps, and those of the query itself after them, in one WITH."""
    if not sql.lstrip().startswith("WITH "):
        return with_steps(sql)
    body = sql.lstrip()[5:]
    shared = with_steps(body)
    return shared.replace("\n" + body, ",\n" + body) if shared != body else sql


def oracle_sql() -> dict[str, str]:
    return {name: _joined(sql) for name, sql in _queries().items()}
