"""SQL for the registered queries, as DuckDB runs it on the same tables.

Steps are named common table expressions; a query names the last ones and gets what they rest on.
"""

from __future__ import annotations

import itertools
import re

from gapbook.operators.costs import ERAS
from gapbook.sources.reference import SECTOR_CODES

_TICKS = """
  SELECT {symbol} AS symbol, {day} AS date, 100 + floor(l_extendedprice / 10) / 10000.0 AS price, l_quantity AS size,
    l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_extendedprice AS o4, l_quantity AS o5
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
_BARS = """
  SELECT date, symbol, first(price ORDER BY o1, o2, o3, o4, o5) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY o1, o2, o3, o4, o5) AS close, CAST(sum(size) AS DOUBLE) AS volume
  FROM {ticks} GROUP BY date, symbol"""


def _returns(bars: str) -> str:
    return f"""
  SELECT *, lead(overnight_return) OVER (PARTITION BY symbol ORDER BY date) AS next_overnight_return,
    lead(date) OVER (PARTITION BY symbol ORDER BY date) AS exit_date
  FROM (SELECT *, open / lag(close) OVER w - 1 AS overnight_return, close / open - 1 AS intraday_return,
      close / lag(close) OVER w - 1 AS close_to_close_return, close * volume AS dollar_volume
    FROM {bars} WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def _features(returns: str, lookback: int, history: int) -> str:
    return f"""
  SELECT * EXCLUDE (n, m, v, c, wins),
    CASE WHEN n >= {history} THEN m END AS overnight_mean, CASE WHEN n >= {history} THEN v END AS overnight_vol,
    CASE WHEN n >= {history} AND v > 0 THEN m / v * sqrt(252.0) END AS overnight_sharpe,
    CASE WHEN c >= {history} THEN wins / c END AS overnight_win_rate
  FROM (SELECT *, count(overnight_return) OVER w AS n, avg(overnight_return) OVER w AS m, stddev_pop(overnight_return) OVER w AS v,
      count(*) OVER w AS c, sum(CASE WHEN overnight_return > 0 THEN 1.0 ELSE 0.0 END) OVER w AS wins,
      CASE WHEN count(*) OVER a >= 5 THEN quantile_cont(dollar_volume, 0.5) OVER a END AS adv_dollars
    FROM {returns}
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW),
      a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _ranked(features: str, least: str, n: str, runs: str = "") -> str:
    return f"""
  SELECT *, date AS signal_date FROM (SELECT *, row_number() OVER (PARTITION BY {runs}date ORDER BY overnight_sharpe DESC, symbol) AS signal_rank
    FROM {features} WHERE overnight_sharpe >= {least} AND next_overnight_return IS NOT NULL AND exit_date IS NOT NULL)
  WHERE signal_rank <= {n}"""


def _weighted(ranked: str, cap: str, equal: bool = False, runs: str = "") -> str:
    """Names above the cap are fixed one by one: the k-th largest score is capped while it would
    come out above the cap with those before it fixed."""
    score = "1.0" if equal else f"CASE WHEN sum(greatest(overnight_sharpe, 0)) OVER (PARTITION BY {runs}date) > 0 THEN greatest(overnight_sharpe, 0) ELSE 1.0 END"
    return f"""
  SELECT * EXCLUDE (score, rest, k, n, ok, kk, rr),
    CASE WHEN kk IS NULL OR k < kk THEN {cap} WHEN rr > 0 THEN score * (least(1.0, {cap} * n) - kk * {cap}) / rr
      ELSE (least(1.0, {cap} * n) - kk * {cap}) / (n - kk) END AS weight
  FROM (SELECT *, min(CASE WHEN ok THEN k END) OVER (PARTITION BY {runs}date) AS kk,
      arg_min(rest, CASE WHEN ok THEN k END) OVER (PARTITION BY {runs}date) AS rr
    FROM (SELECT *, rest = 0 OR score * (least(1.0, {cap} * n) - k * {cap}) <= ({cap} + 1e-12) * rest AS ok
      FROM (SELECT *, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY {runs}date) AS n,
          sum(score) OVER (PARTITION BY {runs}date ORDER BY score DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM (SELECT *, {score} AS score FROM {ranked})
        WINDOW o AS (PARTITION BY {runs}date ORDER BY score DESC, symbol))))"""


_ERA_ROWS = ", ".join(f"(DATE '{d}', {f}, {s}, '{n}')" for d, f, s, n in ERAS)


def _daily(signals: str, runs: str) -> str:
    """Days before compounding, at the cost of their era."""
    return f"""
  SELECT d.*, e.rate_bps AS cost_rate_bps, 2 * gross_exposure * e.rate_bps / 10000 AS cost_return,
    gross_return - 2 * gross_exposure * e.rate_bps / 10000 AS net_return
  FROM (SELECT {runs}signal_date, max(exit_date) AS exit_date, sum(abs(weight)) AS gross_exposure,
      sum(weight * next_overnight_return) AS gross_return, count(*) AS trade_count FROM {signals} GROUP BY {runs}signal_date) d
  ASOF JOIN eras e ON d.signal_date >= e.start"""


def _compounded(days: str, capital: str, runs: str, order: str = "signal_date") -> str:
    return f"""
  SELECT *, coalesce(lag(ending_equity) OVER (PARTITION BY {runs} ORDER BY {order}), {capital}) AS starting_equity
  FROM (SELECT *, {capital} * product(1 + net_return) OVER (PARTITION BY {runs} ORDER BY {order}) AS ending_equity FROM {days})"""


def _metrics(daily: str, runs: str, capital: float, rf: float = 0.0) -> str:
    cols = ", ".join(f"max(CASE WHEN h = '{h}' THEN {m} END) AS rolling_{m}_{h}" for m in ("sharpe", "sortino", "calmar") for h in ("1y", "3y", "5y"))
    eq = " AND ".join(f"m.{r.strip()} = t.{r.strip()}" for r in runs.split(","))
    mruns = ", ".join(f"d.{r.strip()}" for r in runs.split(","))
    qeq = " AND ".join(f"d.{r.strip()} = q.{r.strip()}" for r in runs.split(","))
    return f"""
  SELECT m.* EXCLUDE (cagr0, n0), cagr0 AS cagr, CASE WHEN max_drawdown < 0 THEN cagr0 / abs(max_drawdown) END AS calmar,
    t.* EXCLUDE ({runs}), CAST({capital} AS DOUBLE) AS initial_capital
  FROM (SELECT {mruns}, arg_max(ending_equity, signal_date) AS final_equity, arg_max(ending_equity, signal_date) / {capital} - 1 AS total_return,
      pow(arg_max(ending_equity, signal_date) / {capital}, 1 / CASE WHEN max(exit_date) > min(signal_date) THEN greatest((max(exit_date) - min(signal_date)) / 365.25, 1 / 252.0) ELSE count(net_return) / 252.0 END) - 1 AS cagr0,
      avg(net_return) * 252 AS annualized_return, stddev_pop(net_return) * sqrt(252.0) AS annualized_volatility,
      CASE WHEN stddev_pop(net_return) > 0 THEN (avg(net_return) * 252 - {rf}) / (stddev_pop(net_return) * sqrt(252.0)) END AS sharpe,
      (avg(net_return) * 252 - {rf}) / nullif(sqrt(avg(pow(least(net_return - {rf} / 252, 0), 2))) * sqrt(252.0), 0) AS sortino,
      least(min(dd), 0) AS max_drawdown, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(net_return) AS average_daily_return,
      max(net_return) AS best_day, min(net_return) AS worst_day, any_value(q) AS var_95,
      avg(CASE WHEN net_return <= q THEN net_return END) AS cvar_95,
      CASE WHEN count(net_return) > 2 THEN skewness(net_return) END AS skew, CASE WHEN count(net_return) > 3 THEN kurtosis(net_return) END AS kurtosis,
      sum(CASE WHEN net_return > 0 THEN net_return ELSE 0 END) / nullif(abs(sum(CASE WHEN net_return < 0 THEN net_return END)), 0) AS profit_factor,
      coalesce(avg(CASE WHEN net_return > 0 THEN net_return END), 0) AS average_gain,
      coalesce(avg(CASE WHEN net_return < 0 THEN net_return END), 0) AS average_loss,
      avg(gross_exposure) AS exposure, avg(trade_count) AS average_trade_count, avg(round_trip_turnover) AS average_round_trip_turnover,
      sum(gross_return) AS gross_return_before_costs, sum(cost_return) AS total_cost_return, count(net_return) AS observations,
      CASE WHEN max(exit_date) > min(signal_date) THEN greatest((max(exit_date) - min(signal_date)) / 365.25, 1 / 252.0) ELSE count(net_return) / 252.0 END AS elapsed_years,
      CASE WHEN max(exit_date) > min(signal_date) THEN min(signal_date) END AS start_date,
      CASE WHEN max(exit_date) > min(signal_date) THEN max(exit_date) END AS end_date, count(*) AS n0
    FROM (SELECT *, ending_equity / greatest({capital}, max(ending_equity) OVER (PARTITION BY {runs} ORDER BY signal_date)) - 1 AS dd FROM {daily}) d
    JOIN (SELECT {runs}, quantile_cont(net_return, 0.05) AS q FROM {daily} GROUP BY {runs}) q ON {qeq}
    GROUP BY {mruns}) m
  LEFT JOIN (SELECT {runs}, {cols} FROM (
      SELECT {runs}, h, size, CASE WHEN stddev_pop(net_return) > 0 THEN (avg(net_return) * 252 - {rf}) / (stddev_pop(net_return) * sqrt(252.0)) END AS sharpe,
        (avg(net_return) * 252 - {rf}) / nullif(sqrt(avg(pow(least(net_return - {rf} / 252, 0), 2))) * sqrt(252.0), 0) AS sortino,
        CASE WHEN min(dd) < 0 THEN (pow(arg_min(ending_equity, back) / arg_max(starting_equity, back), 252.0 / count(*)) - 1) / abs(min(dd)) END AS calmar
      FROM (SELECT *, ending_equity / greatest(max(ending_equity) OVER w, first_value(starting_equity) OVER w) - 1 AS dd
        FROM (SELECT *, row_number() OVER (PARTITION BY {runs} ORDER BY exit_date DESC, signal_date DESC) AS back FROM {daily})
        JOIN (VALUES ('1y', 252), ('3y', 756), ('5y', 1260)) AS spans(h, size) ON back <= size
        WINDOW w AS (PARTITION BY {runs}, h ORDER BY back DESC))
      GROUP BY {runs}, h, size HAVING count(*) >= size) GROUP BY {runs}) t ON {eq}"""


#: Settings of the queries, as in the query module.
CAP, CAPITAL = 0.15, 1000000.0

STEPS: dict[str, str] = {
    "ticks": _TICKS.format(symbol="p_brand", day="CAST(l_shipdate AS DATE)"),
    "type_ticks": _TICKS.format(symbol="p_type", day="CAST(l_shipdate AS DATE)"),
    "week_ticks": _TICKS.format(symbol="p_brand", day="CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE)"),
    "bars": _BARS.format(ticks="ticks"),
    "type_bars": _BARS.format(ticks="type_ticks"),
    "week_bars": _BARS.format(ticks="week_ticks"),
    "rets": _returns("bars"),
    "type_rets": _returns("type_bars"),
    "feats": _features("rets", 21, 13),
    "feats42": _features("rets", 42, 20),
    "ranked": _ranked("feats", "0", "10"),
    "sigs": _weighted("ranked", str(CAP)),
    "ranked_equal": _ranked("feats42", "0.5", "5"),
    "sigs_equal": _weighted("ranked_equal", "0.3", equal=True),
    "eras": f"""
  SELECT CASE WHEN row_number() OVER (ORDER BY start) = 1 THEN DATE '0001-01-01' ELSE start END AS start, start AS era_start, fees_bps, slippage_bps, name,
    fees_bps + slippage_bps AS rate_bps, lead(start) OVER (ORDER BY start) AS next_start
  FROM (VALUES {_ERA_ROWS}) AS v(start, fees_bps, slippage_bps, name)""",
    "run_sigs": "SELECT 'base' AS run, * FROM sigs",
    "day_rows": _daily("run_sigs", "run, "),
    "daily": f"""
  SELECT *, 2 * gross_exposure AS round_trip_turnover, starting_equity AS deployed_capital, 0.0 AS cash_weight
  FROM ({_compounded("day_rows", str(CAPITAL), "run")})""",
    # one day after the other: what is deployed, and the weights that the traded volume allows
    "day_list": """
  SELECT row_number() OVER (ORDER BY signal_date) AS k, signal_date, max(exit_date) AS exit_date, count(*) AS trade_count,
    list({'w': weight, 'r': next_overnight_return, 'a': adv_dollars} ORDER BY symbol) AS book
  FROM run_sigs GROUP BY signal_date""",
    "rated_days": "SELECT d.*, e.rate_bps AS rate FROM day_list d ASOF JOIN eras e ON d.signal_date >= e.start",
    "folded": f"""
  SELECT k, signal_date, exit_date, trade_count, rate, start_eq, deployed, x, g, start_eq + deployed * (g - 2 * x * rate / 10000) + (start_eq - deployed) * 0.02 / 252 AS end_eq FROM folded_raw""",
    "limited": """
  SELECT 'base' AS run, signal_date, exit_date, start_eq AS starting_equity, end_eq AS ending_equity, g AS gross_return, 2 * x * rate / 10000 AS cost_return,
    end_eq / start_eq - 1 AS net_return, x AS gross_exposure, 2 * x AS round_trip_turnover, trade_count, rate AS cost_rate_bps, deployed AS deployed_capital,
    (start_eq - deployed) / start_eq AS cash_weight FROM folded""",
    "spells": """
  SELECT p_brand AS symbol, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS n FROM part GROUP BY 1, 2 HAVING n % 5 <> 0""",
    "members": """
  SELECT symbol, make_date(1995 + n % 4, 1, 1) AS a, CASE WHEN n % 2 = 1 THEN make_date(1998 + n % 4, 1, 1) END AS b FROM spells
  UNION ALL SELECT symbol, make_date(1999 + n % 4, 1, 1), NULL FROM spells WHERE n % 2 = 1""",
    "closes": """
  SELECT 'TYPES' AS key, date, avg(close) AS close, 'price' AS kind FROM type_bars GROUP BY date
  UNION ALL SELECT 'RATE', CAST(l_shipdate AS DATE), avg(l_discount) * 1000, 'yield' FROM lineitem GROUP BY 2""",
    "bench": """
  SELECT key, date, ret FROM (SELECT key, date, CASE WHEN kind = 'yield' THEN lag(y) OVER w / 365.25 - 8.0 * (y - lag(y) OVER w) ELSE close / lag(close) OVER w - 1 END AS ret
    FROM (SELECT *, last_value(CASE WHEN close > 0 THEN close / 1000 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY date) AS y FROM closes)
    WINDOW w AS (PARTITION BY key ORDER BY date)) WHERE ret IS NOT NULL""",
    "growth": """
  SELECT key, date, g / first_value(g) OVER (PARTITION BY key ORDER BY date) AS growth
  FROM (SELECT key, date, product(1 + ret) OVER (PARTITION BY key ORDER BY date) AS g
    FROM (SELECT key, date, ret FROM bench UNION ALL SELECT 'strategy', signal_date, net_return FROM daily)),
    (SELECT min(signal_date) AS a, max(signal_date) AS b FROM daily) WHERE date BETWEEN a AND b""",
    "windows": """
  SELECT strftime(era_start, '%Y-%m-%d') AS key, name, fees_bps, slippage_bps, rate_bps AS cost_bps_per_side, greatest(era_start, a) AS start,
    least(coalesce(next_start - 1, b), b) AS "end"
  FROM eras, (SELECT min(signal_date) AS a, max(signal_date) AS b FROM daily) WHERE greatest(era_start, a) <= least(coalesce(next_start - 1, b), b)""",
    "era_days": """
  SELECT w.key, d.*, row_number() OVER o AS k, 10000 * product(1 + gross_return) OVER o AS ge, 10000 * product(1 + net_return) OVER o AS ne
  FROM daily d JOIN windows w ON d.signal_date BETWEEN w.start AND w.end WINDOW o AS (PARTITION BY w.key ORDER BY signal_date)""",
    "era_rows": """
  SELECT key, min(signal_date) AS a, max(signal_date) AS b, count(*) AS days, sum(trade_count) AS trades, arg_max(ge, k) / 10000 - 1 AS gt, arg_max(ne, k) / 10000 - 1 AS nt,
    arg_max(ne, k) AS fin, avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(252.0) AS sh, min(dd) AS mdd,
    min(CASE WHEN ne <= f * 0.5 THEN k END) AS hk, arg_min(signal_date, CASE WHEN ne <= f * 0.5 THEN k END) AS hd,
    min(CASE WHEN ne <= f * 0.1 THEN k END) AS rk, arg_min(signal_date, CASE WHEN ne <= f * 0.1 THEN k END) AS rd
  FROM (SELECT *, ne / max(ne) OVER o - 1 AS dd, first_value(ne) OVER o AS f FROM era_days WINDOW o AS (PARTITION BY key ORDER BY k)) GROUP BY key""",
    "study": """
  SELECT w.key, w.name, e.a AS start, e.b AS "end", days, round_even(days / 252.0, 1) AS years, trades, fees_bps, slippage_bps, cost_bps_per_side,
    gt AS gross_total_return, pow(1 + gt, 252.0 / days) - 1 AS gross_cagr, nt AS net_total_return, pow(1 + nt, 252.0 / days) - 1 AS net_cagr, fin AS net_final_equity,
    sh AS net_sharpe, mdd AS net_max_drawdown,
    CASE WHEN round_even(rk / 21.0, 1) <= 12 THEN 'wipeout within a year' WHEN round_even(hk / 21.0, 1) <= 36 THEN 'capital bleeds out' WHEN nt > 0 THEN 'edge survives costs' ELSE 'slow bleed' END AS verdict,
    false AS empty, hd AS halved_date, round_even(hk / 21.0, 1) AS halved_months, rd AS ruined_date, round_even(rk / 21.0, 1) AS ruined_months
  FROM windows w JOIN era_rows e ON w.key = e.key""",
    "calendar": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM bars)",
    "folds": """
  SELECT row_number() OVER (ORDER BY s) AS fold, a.date AS train_start, b.date AS train_end, c.date AS test_start, d.date AS test_end
  FROM (SELECT unnest(generate_series(0, n - 504 - 1, 126)) AS s, n FROM (SELECT count(*) AS n FROM calendar))
  JOIN calendar a ON a.p = s JOIN calendar b ON b.p = s + 503 JOIN calendar c ON c.p = s + 504 JOIN calendar d ON d.p = least(s + 630, n) - 1""",
    "wf_feats": f"""
  SELECT 21 AS lookback_days, * FROM ({_features("rets", 21, 13)})
  UNION ALL SELECT 42, * FROM ({_features("rets", 42, 26)})""",
    "grid": "SELECT * FROM (VALUES (0, 21, 5), (1, 21, 10), (2, 42, 5), (3, 42, 10)) AS v(candidate, lookback_days, top_n)",
    "wf_rows": "SELECT g.candidate, g.top_n, f.* FROM wf_feats f JOIN grid g ON f.lookback_days = g.lookback_days",
    "wf_ranked": _ranked("wf_rows", "0", "top_n", "candidate, "),
    "wf_sigs": _weighted("wf_ranked", "0.2", runs="candidate, "),
    "wf_days": f"SELECT *, 2 * gross_exposure AS round_trip_turnover FROM ({_daily('wf_sigs', 'candidate, ')})",
    "wf_train": _compounded("(SELECT f.fold, d.* FROM wf_days d JOIN folds f ON d.signal_date BETWEEN f.train_start AND f.train_end)", str(CAPITAL), "fold, candidate"),
    "wf_scores": _metrics("wf_train", "fold, candidate", CAPITAL),
    "wf_best": "SELECT fold, candidate, sharpe AS train_metric FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY sharpe DESC NULLS LAST, candidate) AS k FROM wf_scores) WHERE k = 1",
    "wf_test_days": "SELECT f.fold, d.* FROM wf_days d JOIN folds f ON d.signal_date BETWEEN f.test_start AND f.test_end JOIN wf_best b ON b.fold = f.fold AND b.candidate = d.candidate",
    "wf_test": _compounded("wf_test_days", str(CAPITAL), "fold"),
    "wf_oos": _metrics("wf_test", "fold", CAPITAL),
    "wf_stitched": "SELECT 'oos' AS run, * FROM (" + _compounded("(SELECT 'oos' AS r, * FROM wf_test_days)", str(CAPITAL), "r", "signal_date, fold") + ")",
    "wf_all": _metrics("wf_stitched", "run", CAPITAL),
    "sweep": "SELECT * FROM (VALUES (3), (6), (12)) AS a(top_n), (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.25 AS DOUBLE))) AS b(max_weight)",
    "sweep_rows": "SELECT s.*, f.* FROM feats f, sweep s",
    "sweep_ranked": _ranked("sweep_rows", "0", "top_n", "top_n, max_weight, "),
    "sweep_sigs": _weighted("sweep_ranked", "max_weight", runs="top_n, max_weight, "),
    "sweep_days": f"SELECT *, 2 * gross_exposure AS round_trip_turnover FROM ({_daily('sweep_sigs', 'top_n, max_weight, ')})",
    "sweep_daily": _compounded("sweep_days", str(CAPITAL), "top_n, max_weight"),
    # the estimation set of the part types' overnight returns
    "est": "SELECT date, symbol, overnight_return AS ret FROM type_rets WHERE overnight_return IS NOT NULL",
    "est_dates": "SELECT date, count(*) AS n FROM est GROUP BY date",
    "est_start": "SELECT count(*) AS obs, (SELECT count(DISTINCT symbol) FROM est) AS syms, min(CASE WHEN n >= 0.75 * (SELECT count(DISTINCT symbol) FROM est) THEN date END) AS s FROM est_dates",
    "est_work": "SELECT e.* FROM est e, est_start WHERE date >= s",
    "est_len": "SELECT count(DISTINCT date) AS len FROM est_work",
    "est_recent": "SELECT date FROM (SELECT DISTINCT date FROM est_work) ORDER BY date DESC LIMIT 10",
    "est_syms": """
  SELECT symbol, rung FROM (SELECT symbol, count(*) AS n, max(CASE WHEN date IN (SELECT date FROM est_recent) THEN 1 ELSE 0 END) AS late FROM est_work GROUP BY symbol), est_len,
    (VALUES (0.98), (0.95), (0.90), (0.80), (0.70), (0.60)) AS r(rung) WHERE late = 1 AND n >= least(252, greatest(20, floor(len * 0.05))) AND n / len >= rung""",
    "est_rung": "SELECT max(rung) AS rung FROM (SELECT rung FROM est_syms GROUP BY rung HAVING count(*) >= 2)",
    "est_kept": "SELECT symbol FROM est_syms WHERE rung = (SELECT rung FROM est_rung)",
    "complete": """
  SELECT date, symbol, ret FROM est_work WHERE symbol IN (SELECT symbol FROM est_kept)
    AND date IN (SELECT date FROM est_work WHERE symbol IN (SELECT symbol FROM est_kept) GROUP BY date HAVING count(*) = (SELECT count(*) FROM est_kept))""",
    "pair_cov": """
  SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS c FROM complete x JOIN complete y ON x.date = y.date AND x.symbol <= y.symbol GROUP BY 1, 2""",
    "mix_rates": """
  SELECT symbol, 1.0 / 10000 + 2.0 / 10000 * greatest(0.25, least(4.0, v / m)) AS rate
  FROM (SELECT symbol, stddev_pop(ret) AS v FROM complete GROUP BY symbol), (SELECT avg(v) AS m FROM (SELECT stddev_pop(ret) AS v FROM complete GROUP BY symbol))""",
    "mix_rows": """
  SELECT c.date, c.symbol, c.ret, r.rate, p.port, c.date = (SELECT min(date) FROM complete) AS first, abs(0.1 * (1 + c.ret) / (1 + p.port) - 0.1) AS moved
  FROM complete c JOIN mix_rates r ON c.symbol = r.symbol JOIN (SELECT date, sum(0.1 * ret) AS port FROM complete GROUP BY date) p ON c.date = p.date""",
    "mix_days": """
  SELECT 'equal' AS portfolio, date, any_value(port) AS gross_return, sum(CASE WHEN first THEN 0.1 ELSE moved END * rate) AS cost_return, sum(CAST(0.1 AS DOUBLE)) AS gross_exposure,
    count(*) AS trade_count, sum(CASE WHEN first THEN CAST(0.1 AS DOUBLE) ELSE moved END) AS round_trip_turnover FROM mix_rows GROUP BY date""",
    "est_calendar": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM complete)",
    "last_known": "SELECT symbol AS brand, max(date) AS last FROM ticks WHERE date <= DATE '2001-06-30' AND symbol NOT LIKE '%5' GROUP BY symbol",
    "dirty": """
  SELECT CASE WHEN n % 29 <> 0 THEN CASE WHEN n % 37 = 0 THEN '7025-03-07' WHEN n % 41 = 0 THEN 'soon' ELSE strftime(date, '%Y-%m-%d') END END AS date,
    ' ' || lower(symbol) || '.x ' AS symbol, open, high, low, CASE WHEN n % 31 <> 0 THEN close END AS close, volume, 0 AS seq, n
  FROM (SELECT *, dayofyear(date) AS n FROM bars)""",
    "raw": "SELECT * FROM dirty UNION ALL SELECT date, symbol, open, high, low, 99.5, volume, 1, n FROM dirty WHERE n % 3 = 0",
}
_RECURSIVE = {
    "folded_raw": """
  SELECT k, signal_date, exit_date, trade_count, rate, CAST(1000000 AS DOUBLE) AS start_eq, CAST(600011.7 AS DOUBLE) AS deployed,
    list_sum(list_transform(book, lambda t: abs(least(t.w, t.a * 1.93719::DOUBLE / 600011.7::DOUBLE)))) AS x, list_sum(list_transform(book, lambda t: least(t.w, t.a * 1.93719::DOUBLE / 600011.7::DOUBLE) * t.r)) AS g
  FROM rated_days WHERE k = 1
  UNION ALL
  SELECT d.k, d.signal_date, d.exit_date, d.trade_count, d.rate, q.eq, least(q.eq, 600011.7::DOUBLE),
    list_sum(list_transform(d.book, lambda t: abs(least(t.w, t.a * 1.93719::DOUBLE / least(q.eq, 600011.7::DOUBLE))))), list_sum(list_transform(d.book, lambda t: least(t.w, t.a * 1.93719::DOUBLE / least(q.eq, 600011.7::DOUBLE)) * t.r))
  FROM (SELECT k, start_eq + deployed * (g - 2 * x * rate / 10000) + (start_eq - deployed) * 0.02 / 252 AS eq FROM folded_raw) q JOIN rated_days d ON d.k = q.k + 1""",
}


def with_steps(final: str) -> str:
    """``final`` after all steps that it rests on."""
    everything = STEPS | _RECURSIVE
    needed: list[str] = []

    def add(text: str, own: str = "") -> None:
        for name in re.findall(r"\b[a-z][a-z_0-9]*\b", text):
            if name in everything and name != own and name not in needed:
                add(everything[name], name)
                needed.append(name)

    add(final)
    if not needed:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({everything[n]})" for n in needed) + "\n" + final


def _rounded(names: str, digits: int) -> str:
    return ", ".join(f"round({n.strip()}, {digits}) AS {n.strip()}" for n in names.split(","))


def _by_scale(names: str, digits: int = 9, money: int = 3) -> str:
    """As the queries round: money to less than a cent, shares to ``digits`` places."""
    return ", ".join(f"round({n.strip()}, {money if n.strip() in MONEY else digits}) AS {n.strip()}" for n in names.split(","))


MONEY = ("starting_equity", "ending_equity", "deployed_capital")
OHLCV = "open, high, low, close, volume"
DAILY = "starting_equity, ending_equity, gross_return, cost_return, net_return, gross_exposure, round_trip_turnover, cost_rate_bps, deployed_capital, cash_weight"
METRICS = (
    "final_equity, total_return, cagr, annualized_return, annualized_volatility, sharpe, sortino, max_drawdown, win_rate, average_daily_return, best_day, worst_day, var_95, cvar_95, skew, "
    "kurtosis, profit_factor, average_gain, average_loss, exposure, average_trade_count, average_round_trip_turnover, gross_return_before_costs, total_cost_return, elapsed_years, calmar, "
    + ", ".join(f"rolling_{m}_{h}" for m, h in itertools.product(("sharpe", "sortino", "calmar"), ("1y", "3y", "5y")))
    + ", initial_capital"
)
BOOK = "weight, overnight_sharpe, overnight_mean, overnight_vol, overnight_win_rate, adv_dollars, next_overnight_return"
RELATIVE = "strategy_total_return, benchmark_total_return, strategy_cagr, benchmark_cagr, benchmark_volatility, benchmark_sharpe, benchmark_max_drawdown, correlation, beta, alpha_annualized, tracking_error, information_ratio, up_capture, down_capture"


def _metrics_query(daily: str, runs: str, rf: float = 0.0) -> str:
    return f"SELECT {runs}, observations, start_date, end_date, {_rounded(METRICS, 6)} FROM ({_metrics(daily, runs, CAPITAL, rf)})"


def _bars_query(rows: str) -> str:
    return f"SELECT date, symbol, {_rounded(OHLCV, 8)} FROM {rows}"


def _blotter(daily: str, weight: str) -> str:
    return f"""
  SELECT s.run, s.signal_date, s.exit_date, symbol, {weight} AS weight, next_overnight_return AS overnight_return, deployed_capital * {weight} AS notional,
    deployed_capital * {weight} * next_overnight_return AS gross_pnl, abs({weight}) / gross_exposure * deployed_capital * cost_return AS cost,
    deployed_capital * {weight} * next_overnight_return - abs({weight}) / gross_exposure * deployed_capital * cost_return AS net_pnl, signal_rank, overnight_sharpe
  FROM run_sigs s JOIN {daily} d ON s.signal_date = d.signal_date"""


_BLOTTER = "weight, overnight_return, notional, gross_pnl, cost, net_pnl, overnight_sharpe"
_CURVE = "SELECT run, exit_date AS date, ending_equity AS equity, ending_equity / max(ending_equity) OVER (PARTITION BY run ORDER BY signal_date) - 1 AS drawdown FROM daily"
_SYMBOL = "replace(upper(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '.', '-')"
_CLEAN = f"""SELECT d AS date, s AS symbol, {OHLCV} FROM (SELECT *, row_number() OVER (PARTITION BY d, s ORDER BY seq DESC) AS k
    FROM (SELECT *, try_cast(date AS DATE) AS d, {_SYMBOL.format("symbol")} AS s FROM raw)
    WHERE d <= DATE '2002-01-06' AND close IS NOT NULL) WHERE k = 1"""
_CODES = "CASE " + " ".join(f"WHEN sector = '{s}' THEN '{c}'" for s, c in SECTOR_CODES.items()) + " ELSE 'OTHER' END"


def _queries() -> dict[str, str]:
    trades = _blotter("daily", "weight")
    n_money = "total_net_pnl, total_gross_pnl, total_cost, total_notional, average_weight, win_rate, average_trade_pnl, best_trade_pnl, worst_trade_pnl"
    return {
        "bars_daily": _bars_query("bars"),
        "bars_weekly": _bars_query("week_bars"),
        "bars_cleaned": _bars_query(f"({_CLEAN})"),
        "bars_validation": """
SELECT CAST(sum(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_keys, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS non_numeric, CAST(0 AS BIGINT) AS non_positive_price,
  CAST(sum(CASE WHEN dayofmonth(d) = 5 THEN 1 ELSE 0 END) AS BIGINT) AS negative_volume,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT try_cast(date AS DATE), symbol FROM raw)) AS BIGINT) AS duplicate_keys, count(*) AS rows
FROM (SELECT *, try_cast(date AS DATE) AS d FROM raw)""",
        "history_merged": f"SELECT date, upper(symbol) AS symbol, {_rounded('open, high, low', 8)}, round(CASE WHEN year(date) >= 2001 THEN close + 1 ELSE close END, 8) AS close, round(volume, 8) AS volume FROM bars WHERE year(date) <= 2001 OR year(date) >= 2001",
        "fetch_planned": """
SELECT upper(p_brand) AS symbol, CASE WHEN last IS NULL THEN 'fresh' ELSE 'cached' END AS status,
  CASE WHEN last IS NULL THEN DATE '1995-01-01' ELSE greatest(DATE '1995-01-01', (SELECT min(last) FROM last_known) - 10) END AS fetch_start
FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN last_known ON brand = upper(p_brand)""",
        "symbols_missing": "SELECT upper(p_brand) AS symbol FROM part WHERE upper(p_brand) NOT IN (SELECT upper(symbol) FROM bars WHERE symbol LIKE '%1' AND date < DATE '1998-01-01') GROUP BY 1",
        "bars_window": f"SELECT date, upper(symbol) AS symbol, {_rounded(OHLCV, 8)} FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND symbol IN ('Brand#11', 'Brand#23')",
        "bars_sample": f"""
SELECT date, symbol, {_rounded(OHLCV, 8)} FROM bars WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 7)
  AND date IN (SELECT DISTINCT date FROM bars WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 7) ORDER BY date DESC LIMIT 250)""",
        "bars_data_window": "SELECT min(date) AS start_date, max(date) AS end_date, count(DISTINCT symbol) AS symbols, count(*) AS rows FROM bars",
        "vendor_wide": f"SELECT date, symbol, {_rounded(OHLCV, 8)} FROM type_bars",
        "ticker_lists": """
SELECT brand, string_agg(w, '|' ORDER BY f) AS symbols FROM (SELECT brand, w, min(k) AS f FROM (
    SELECT brand, replace(upper(unnest(parts)), '.', '-') AS w, generate_subscripts(parts, 1) AS k FROM (
      SELECT p_brand AS brand, list_filter(regexp_split_to_array(string_agg(DISTINCT p_type, ', ' ORDER BY p_type), '[\\n ,]'), lambda s: trim(s) <> '') AS parts FROM part GROUP BY p_brand))
  GROUP BY brand, w) GROUP BY brand""",
        "universe_metadata": f"""
SELECT upper(symbol) AS symbol, coalesce(name, upper(symbol)) AS name, coalesce(sector, 'Unclassified') AS sector, {_CODES} AS sector_code, round(cap, 2) AS market_cap,
  symbol NOT LIKE '%5' AND symbol IN (SELECT symbol FROM bars) AS in_price_cache,
  CASE WHEN cap IS NULL OR cap <= 0 THEN '-' WHEN cap >= 1e12 THEN printf('%.2fT', cap / 1e12) WHEN cap >= 1e9 THEN printf('%.1fB', cap / 1e9) ELSE printf('%.0fM', cap / 1e6) END AS cap_label
FROM (SELECT p_brand AS symbol, CASE WHEN p_brand NOT LIKE '%3' THEN 'Maker of ' || p_brand END AS name,
    CASE WHEN p_brand LIKE '%3' THEN NULL WHEN p_brand LIKE '%1' THEN 'Energy' WHEN p_brand LIKE '%2' THEN 'Utilities' ELSE min(p_type) END AS sector,
    CASE WHEN p_brand NOT LIKE '%4' THEN round(max(p_retailprice), 0) * 1e8 END AS cap FROM part GROUP BY p_brand)""",
        "event_bars": """
SELECT date, symbol, round(first(price ORDER BY ts, event_id), 8) AS open, round(max(price), 8) AS high, round(min(price), 8) AS low, round(last(price ORDER BY ts, event_id), 8) AS close,
  CAST(count(*) AS DOUBLE) AS volume
FROM (SELECT 'U' || user_id AS symbol, date_trunc('hour', ts) AS date, value AS price, ts, event_id FROM events) GROUP BY date, symbol""",
        "overnight_features": f"SELECT date, symbol, exit_date, {_rounded('overnight_return, intraday_return, close_to_close_return, next_overnight_return, overnight_mean, overnight_vol, overnight_sharpe, overnight_win_rate, dollar_volume, adv_dollars', 7)} FROM feats",
        "long_returns": "SELECT date, symbol, round(close_to_close_return, 8) AS ret FROM rets WHERE close_to_close_return IS NOT NULL",
        "overnight_signals": f"SELECT signal_date, exit_date, symbol, {_rounded(BOOK, 7)}, signal_rank FROM sigs",
        "equal_signals": f"SELECT signal_date, exit_date, symbol, {_rounded(BOOK, 7)}, signal_rank FROM sigs_equal",
        "latest_holdings": f"SELECT signal_date, exit_date, symbol, {_rounded(BOOK, 7)}, signal_rank FROM sigs WHERE signal_date = (SELECT max(signal_date) FROM sigs) ORDER BY sigs.weight DESC, symbol LIMIT 5",
        "target_orders": "SELECT symbol, round(weight, 7) AS target_weight, 'rank ' || signal_rank AS reason, printf('Would target %.2f%%: rank %d', weight * 100, signal_rank) AS report FROM sigs WHERE signal_date = (SELECT max(signal_date) FROM sigs) AND weight > 1e-6",
        "member_bars": f"SELECT date, symbol, {_rounded(OHLCV, 8)} FROM bars b WHERE EXISTS (SELECT 1 FROM members m WHERE m.symbol = b.symbol AND b.date >= m.a AND (m.b IS NULL OR b.date <= m.b))",
        "membership_report": """
SELECT (SELECT count(DISTINCT symbol) FROM members) AS member_symbols, (SELECT count(DISTINCT symbol) FROM bars) AS price_symbols, count(*) AS missing_count,
  string_agg(symbol, ',' ORDER BY symbol) AS missing_symbols, true AS point_in_time, printf('%d price symbols have no membership spell and are excluded.', count(*)) AS warning
FROM (SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN (SELECT symbol FROM members))""",
        "cost_as_of": "SELECT d.signal_date, e.rate_bps AS cost_rate_bps FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS signal_date FROM orders) d ASOF JOIN eras e ON d.signal_date >= e.start",
        "backtest_daily": f"SELECT run, signal_date, exit_date, trade_count, {_by_scale(DAILY)} FROM daily",
        "backtest_limited": f"SELECT run, signal_date, exit_date, trade_count, {_by_scale(DAILY)} FROM limited",
        "trade_blotter": f"SELECT run, signal_date, exit_date, symbol, signal_rank, {_rounded(_BLOTTER, 5)} FROM ({trades})",
        "trade_blotter_limited": f"SELECT run, signal_date, exit_date, symbol, signal_rank, {_rounded(_BLOTTER, 3)} FROM ({_blotter('limited', 'least(weight, adv_dollars * 1.93719::DOUBLE / deployed_capital)')})",
        "equity_curve": f"SELECT run, date, {_rounded('equity, drawdown', 6)} FROM ({_CURVE})",
        "equity_curve_range": f"SELECT run, date, {_rounded('equity, drawdown', 6)} FROM ({_CURVE}) WHERE date >= (SELECT max(exit_date) FROM daily) - 1095",
        "performance": _metrics_query("daily", "run", 0.01),
        "performance_sweep": _metrics_query("sweep_daily", "top_n, max_weight"),
        "var_cvar_by_symbol": """
SELECT r.symbol, round(any_value(v), 8) AS "var", round(avg(CASE WHEN overnight_return <= v THEN overnight_return END), 8) AS cvar
FROM rets r JOIN (SELECT symbol, quantile_cont(overnight_return, 1 - 0.9::DOUBLE) AS v FROM rets GROUP BY symbol) q ON r.symbol = q.symbol GROUP BY r.symbol""",
        "close_drawdowns": "SELECT date, symbol, round(close, 8) AS close, round(close / max(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 8) AS drawdown FROM bars",
        "trades_filtered": f"""
SELECT signal_date, exit_date, symbol, signal_rank, {_rounded(_BLOTTER, 5)} FROM (SELECT * FROM ({trades})
  WHERE exit_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND symbol LIKE '%#2%' AND net_pnl > 0 ORDER BY exit_date DESC, signal_date DESC, symbol DESC, signal_rank DESC LIMIT 200)""",
        "trades_summary": f"""
SELECT a.*, b.* REPLACE ({_rounded(n_money, 4)}), least(filtered_trades, 200) AS returned_trades
FROM (SELECT count(*) AS source_total_trades, count(DISTINCT symbol) AS source_symbols, min(exit_date) AS source_start_date, max(exit_date) AS source_end_date FROM ({trades})) a,
  (SELECT count(*) AS filtered_trades, min(exit_date) AS filtered_start_date, max(exit_date) AS filtered_end_date, max(signal_date) AS latest_entry_date, max(exit_date) AS latest_exit_date,
    count(*) FILTER (exit_date = (SELECT max(exit_date) FROM sigs WHERE symbol LIKE '%#3%')) AS latest_trade_count, sum(net_pnl) AS total_net_pnl, sum(gross_pnl) AS total_gross_pnl, sum(cost) AS total_cost,
    sum(notional) AS total_notional, avg(weight) AS average_weight, avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(net_pnl) AS average_trade_pnl, max(net_pnl) AS best_trade_pnl,
    min(net_pnl) AS worst_trade_pnl, count(DISTINCT symbol) AS filtered_symbols FROM ({trades}) WHERE exit_date >= DATE '1998-01-01' AND symbol LIKE '%#3%') b""",
        "benchmark_returns": "SELECT key, date, round(ret, 8) AS ret FROM bench",
        "relative_to_benchmarks": f"""
SELECT key, observations, {_rounded(RELATIVE, 6)} FROM (SELECT *, pow(1 + strategy_total_return, 252.0 / observations) - 1 AS strategy_cagr, pow(1 + benchmark_total_return, 252.0 / observations) - 1 AS benchmark_cagr,
    ms - beta * mb AS alpha_annualized
  FROM (SELECT key, count(*) AS observations, product(1 + s) - 1 AS strategy_total_return, product(1 + b) - 1 AS benchmark_total_return, stddev_pop(b) * sqrt(252.0) AS benchmark_volatility,
      avg(b) * 252 / (stddev_pop(b) * sqrt(252.0)) AS benchmark_sharpe, min(dd) AS benchmark_max_drawdown, corr(s, b) AS correlation, covar_pop(s, b) / var_pop(b) AS beta,
      stddev_pop(s - b) * sqrt(252.0) AS tracking_error, avg(s - b) * 252 / (stddev_pop(s - b) * sqrt(252.0)) AS information_ratio, avg(s) * 252 AS ms, avg(b) * 252 AS mb,
      avg(CASE WHEN b > 0 THEN s END) / avg(CASE WHEN b > 0 THEN b END) AS up_capture, avg(CASE WHEN b < 0 THEN s END) / avg(CASE WHEN b < 0 THEN b END) AS down_capture
    FROM (SELECT *, e / max(e) OVER (PARTITION BY key ORDER BY date) - 1 AS dd FROM (SELECT key, date, ret AS b, net_return AS s, product(1 + ret) OVER (PARTITION BY key ORDER BY date) AS e
      FROM bench JOIN daily ON date = signal_date)) GROUP BY key HAVING count(*) >= 20))""",
        "benchmark_growth": "SELECT key, date, round(growth, 7) AS growth FROM growth",
        "benchmark_growth_wide": """SELECT date, round(max(CASE WHEN key = 'strategy' THEN growth END), 7) AS strategy, round(max(CASE WHEN key = 'TYPES' THEN growth END), 7) AS "TYPES", round(max(CASE WHEN key = 'RATE' THEN growth END), 7) AS "RATE" FROM growth GROUP BY date""",
        "benchmark_growth_common": """
SELECT key, date, round(growth / first_value(growth) OVER (PARTITION BY key ORDER BY date), 7) AS growth FROM growth WHERE date IN (SELECT date FROM growth GROUP BY date HAVING count(*) = 3)""",
        "benchmark_refresh": "SELECT key, date, round(CASE WHEN year(date) < 2000 THEN close ELSE close + 1 END, 8) AS close FROM closes",
        "era_windows": "SELECT * FROM windows",
        "era_study": f"""SELECT * REPLACE ({_rounded("years, fees_bps, slippage_bps, cost_bps_per_side, gross_total_return, gross_cagr, net_total_return, net_cagr, net_final_equity, net_sharpe, net_max_drawdown", 6)}) FROM study""",
        "era_conclusion": """
SELECT arg_min(name, start) FILTER (net_total_return > 0) AS first_profitable_era, min(start) FILTER (net_total_return > 0) AS first_profitable_start, count(*) AS eras_tested,
  bool_and(gross_total_return > 0) AS gross_edge_all_eras, count(ruined_date) AS ruined_eras, count(*) FILTER (net_total_return > 0) AS survivors, min(ruined_months) AS fastest_ruin_months FROM study""",
        "walk_forward_windows": "SELECT * FROM folds",
        "walk_forward_folds": f"""
SELECT f.fold, f.train_start, f.train_end, f.test_start, f.test_end, g.lookback_days, g.top_n, CAST(0 AS DOUBLE) AS min_signal, round(b.train_metric, 6) AS train_metric,
  round(o.sharpe, 6) AS oos_sharpe, round(o.cagr, 6) AS oos_cagr, round(o.max_drawdown, 6) AS oos_max_drawdown, o.observations AS oos_days
FROM folds f JOIN wf_best b ON f.fold = b.fold JOIN grid g ON g.candidate = b.candidate JOIN wf_oos o ON o.fold = f.fold""",
        "walk_forward_oos": f"SELECT run, observations, start_date, end_date, {_rounded(METRICS, 6)} FROM wf_all",
        "walk_forward_decay": "SELECT round(sharpe, 6) AS sharpe, round(m, 6) AS in_sample_average, round(1 - sharpe / m, 6) AS sharpe_decay FROM wf_all, (SELECT avg(train_metric) AS m FROM wf_best)",
        "estimation_rows": "SELECT date, symbol, round(ret, 8) AS ret FROM complete",
        "estimation_report": """
SELECT obs AS input_observations, syms AS input_symbols, s AS coverage_start_date, coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM est WHERE symbol NOT IN (SELECT symbol FROM est_kept))), '') AS excluded_symbols,
  (SELECT count(DISTINCT date) FROM complete) AS output_observations, (SELECT count(DISTINCT symbol) FROM complete) AS output_symbols, (SELECT min(date) FROM complete) AS start_date,
  (SELECT max(date) FROM complete) AS end_date, CAST((SELECT rung FROM est_rung) AS DOUBLE) AS symbol_coverage_threshold FROM est_start""",
        "expected_returns": """
SELECT c.symbol, round(avg(ret), 9) AS mean, round(median(ret), 9) AS median, round(avg(least(greatest(ret, a), b)), 9) AS winsorized
FROM complete c JOIN (SELECT symbol, quantile_cont(ret, 0.02) AS a, quantile_cont(ret, 0.98) AS b FROM complete GROUP BY symbol) q ON c.symbol = q.symbol GROUP BY c.symbol""",
        "covariance_matrix": "SELECT a, b, round((c + CASE WHEN a = b THEN (SELECT greatest(avg(c) * 1e-8, 1e-10) FROM pair_cov WHERE a = b) ELSE 0 END) * 1e6, 6) AS cov FROM pair_cov",
        "covariance_matrix_blocks": "SELECT a, b, round((c + CASE WHEN a = b THEN (SELECT greatest(avg(c) * 1e-8, 1e-10) FROM pair_cov WHERE a = b) ELSE 0 END) * 1e6, 6) AS cov FROM pair_cov",
        "symbol_cost_rates": """
SELECT symbol, round(1.0 / 10000 + 2.0 / 10000 * greatest(0.25, least(4.0, v / m)), 10) AS rate
FROM (SELECT symbol, stddev_pop(overnight_return) AS v FROM rets GROUP BY symbol), (SELECT avg(v) AS m FROM (SELECT stddev_pop(overnight_return) AS v FROM rets GROUP BY symbol))""",
        "constant_mix_path": f"""
SELECT portfolio, date AS exit_date, date AS signal_date, trade_count, {_by_scale("gross_return, cost_return, gross_exposure, round_trip_turnover, net_return, ending_equity, starting_equity", 10)}
FROM ({_compounded("(SELECT *, gross_return - cost_return AS net_return FROM mix_days)", str(CAPITAL), "portfolio", "date")})""",
        "constant_mix_statistics": f"""
SELECT 'equal' AS portfolio, {_rounded("expected_return, volatility, sharpe, var_95, cvar_95", 7)} FROM (SELECT avg(gross_return) * 252 AS expected_return, stddev_pop(gross_return) * sqrt(252.0) AS volatility,
    avg(gross_return) * 252 / (stddev_pop(gross_return) * sqrt(252.0)) AS sharpe, any_value(q) AS var_95, avg(CASE WHEN gross_return <= q THEN gross_return END) AS cvar_95
  FROM mix_days, (SELECT quantile_cont(gross_return, 0.05) AS q FROM mix_days))""",
        "rebalance_calendar": "SELECT date, pos, row_number() OVER (ORDER BY date) AS rebalance FROM (SELECT min(date) AS date, arg_min(pos, date) AS pos FROM est_calendar WHERE pos >= 252 GROUP BY date_trunc('quarter', date))",
    }


def oracle_sql() -> dict[str, str]:
    return {name: with_steps(sql) for name, sql in _queries().items()}
