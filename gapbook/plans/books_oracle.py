"""SQL for the queries of optimized portfolios: of ``books``, and those of ``queries`` and ``files`` whose
weights are found by iteration."""

from __future__ import annotations

import re
from dataclasses import replace

from gapbook.operators import optimizers as opt
from gapbook.operators.nightly import NightlySettings
from gapbook.operators.portfolio import PortfolioSettings
from gapbook.plans import books, files, queries
from gapbook.plans.files_oracle import _RATES, _joined
from gapbook.plans.optimizer_oracle import projection, rebalanced, static, suite
from gapbook.plans.oracle import CAPITAL, DAILY, METRICS, STEPS, _by_scale, _compounded, _metrics, _rounded

_CHAIN = ("est", "est_dates", "est_start", "est_work", "est_len", "est_recent", "est_syms", "est_rung", "est_kept", "complete")
#: A year of daily rows, from which on annual growth is told.
_YEAR = 252


def _recent(days: int, whole: bool) -> str:
    """The estimation set of the last dates: with symbols chosen by coverage, or all of them."""
    last = f"d_est AS (SELECT e.* FROM ({STEPS['est']}) e WHERE date IN (SELECT DISTINCT date FROM ({STEPS['est']}) ORDER BY date DESC LIMIT {days}))"
    if whole:
        return f"{last}, d_complete AS (SELECT * FROM d_est WHERE date IN (SELECT date FROM d_est GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM d_est)))"
    names = "|".join(sorted(_CHAIN, key=len, reverse=True))
    return ",\n".join([last, *(f"d_{n} AS ({re.sub(rf'\b({names})\b', r'd_\1', STEPS[n])})" for n in _CHAIN[1:])])


def _summary(p: str, s: PortfolioSettings, frequency: str) -> str:
    """Results, exposures and settings of each portfolio."""
    said = " ".join(f"WHEN '{m}' THEN '{s.optimizer.parameters(m)}'" for m in opt.SUITE)
    held = f"{p}_weights" if frequency == "none" else f"{p}_latest"
    turns = f"JOIN {p}_turns t ON t.portfolio = m.portfolio" if frequency != "none" else ""
    own = "rebalance_count, round(average_turnover, 6) AS average_turnover, last_rebalance_date" if turns else "0 AS rebalance_count, 0.0::DOUBLE AS average_turnover, NULL::DATE AS last_rebalance_date"
    metrics = [x for x in re.split(r",\s*", METRICS) if x not in ("cagr", "calmar")]
    return f"""
SELECT m.portfolio, observations, start_date, end_date, {", ".join(f"round(m.{x}, 6) AS {x}" for x in metrics)},
  CASE WHEN observations >= {_YEAR} THEN round(cagr, 6) END AS cagr, CASE WHEN observations >= {_YEAR} THEN round(calmar, 6) END AS calmar,
  round(annualized_return, 6) AS expected_return, round(annualized_volatility, 6) AS volatility, {_rounded("weight_sum, gross_exposure, max_weight, cash_weight", 6)}, positions,
  '{frequency}' AS rebalance_frequency, {own}, {s.optimizer.max_weight}::DOUBLE AS max_weight_limit, CASE m.portfolio {said} ELSE '' END AS optimizer_parameters
FROM ({_metrics(f"{p}_daily", "portfolio", CAPITAL)}) m {turns}
JOIN (SELECT portfolio, sum(weight) AS weight_sum, sum(abs(weight)) AS gross_exposure, max(weight) AS max_weight, greatest(0.0, 1 - sum(weight)) AS cash_weight, count(*) FILTER (abs(weight) > 1e-6) AS positions FROM {held} GROUP BY portfolio) e
  ON e.portfolio = m.portfolio"""


def _daily(p: str) -> str:
    return f"{p}_daily AS ({_compounded(f'{p}_path', str(CAPITAL), 'portfolio')})"


def _static(s: PortfolioSettings, rows: str = "complete") -> str:
    return static(rows, s.optimizer, s.fees_bps, s.slippage_bps)


def _rebalanced(s: PortfolioSettings, period: str) -> str:
    return rebalanced("complete", replace(s.optimizer, iterations=220, cvar_iterations=160), period, 252, s.fees_bps, s.slippage_bps)


def _nights(s: NightlySettings) -> str:
    """Books of each night, weights by all methods, and daily results."""
    named = {"kelly": 0, "mean_variance": 1, "minimum_variance": 2, "inverse_volatility": 3, "cvar": 4, "black_litterman": 5}
    cap, least = s.optimizer.max_weight, max(20, s.min_history)

    def projected(v: str) -> str:
        return projection(f"SELECT date, {cap}::DOUBLE AS cap, least(1.0::DOUBLE, {cap}::DOUBLE * len(syms)) AS total, {v} AS v, syms FROM n_given", "date, syms")

    by_name = " UNION ALL ".join(f"SELECT '{m}' AS method, k AS date, symbol, weight FROM n_weights WHERE portfolio = '{opt.SUITE[i]}'" for m, i in named.items())
    all_methods = ", ".join(f"('{m}')" for m in opt.NIGHTLY)
    return f"""
WITH n_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY overnight_sharpe DESC, symbol) AS signal_rank FROM feats
    WHERE overnight_sharpe >= {s.min_signal} AND next_overnight_return IS NOT NULL AND exit_date IS NOT NULL) WHERE signal_rank <= {s.top_n}),
n_cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM rets WHERE overnight_return IS NOT NULL)),
n_book AS (SELECT t.date, t.exit_date, t.symbol, t.signal_rank, t.overnight_sharpe, t.next_overnight_return AS r, c.pos, count(*) OVER (PARTITION BY t.date) AS n FROM n_best t LEFT JOIN n_cal c ON c.date = t.date),
n_past AS (SELECT b.date AS k, b.symbol, b.n, c.pos AS date, o.overnight_return AS ret FROM n_book b JOIN n_cal c ON c.pos > b.pos - {s.estimation_days} AND c.pos <= b.pos JOIN rets o ON o.symbol = b.symbol AND o.date = c.date WHERE o.overnight_return IS NOT NULL),
n_common AS (SELECT k, date FROM n_past GROUP BY k, date HAVING count(*) = any_value(n)),
n_long AS (SELECT k FROM n_common GROUP BY k HAVING count(*) >= {least}),
n_rows AS (SELECT p.k, p.date, p.symbol, p.ret FROM n_past p JOIN n_common c ON c.k = p.k AND c.date = p.date JOIN n_long l ON l.k = p.k),{suite("n_rows", s.optimizer, "n")},
n_given AS (SELECT date, list(symbol ORDER BY symbol) AS syms, CASE WHEN sum(greatest(overnight_sharpe, 0)) > 0 THEN list(greatest(overnight_sharpe, 0) ORDER BY symbol) ELSE list(1.0::DOUBLE) END AS score FROM n_book GROUP BY date),
n_scored AS (SELECT date, unnest(syms) AS symbol, unnest(w) AS weight FROM ({projected("score")})),
n_equal AS (SELECT date, unnest(syms) AS symbol, unnest(w) AS weight FROM ({projected("list_transform(syms, lambda y: 1.0::DOUBLE)")})),
n_own AS ({by_name} UNION ALL SELECT 'equal_weight', e.* FROM n_equal e JOIN n_long l ON l.k = e.date UNION ALL SELECT 'score_weighted', * FROM n_scored),
n_held AS (SELECT m.method, b.date, b.symbol, b.exit_date, b.signal_rank, b.overnight_sharpe, b.r, coalesce(o.weight, q.weight) AS weight, o.weight IS NULL AS fallback, dense_rank() OVER (ORDER BY b.date) AS night
  FROM n_book b CROSS JOIN (VALUES {all_methods}) AS m(method) JOIN n_scored q ON q.date = b.date AND q.symbol = b.symbol LEFT JOIN n_own o ON o.method = m.method AND o.date = b.date AND o.symbol = b.symbol),
n_old AS (SELECT method, night + 1 AS night, symbol, weight * (1 + r) / (1 + sum(weight * r) OVER (PARTITION BY method, night)) AS was FROM n_held),
n_both AS (SELECT coalesce(h.method, o.method) AS method, coalesce(h.night, o.night) AS night, coalesce(h.symbol, o.symbol) AS symbol, h.weight, h.r, h.fallback, abs(coalesce(h.weight, 0) - coalesce(o.was, 0)) AS change
  FROM n_held h FULL JOIN n_old o ON o.method = h.method AND o.night = h.night AND o.symbol = h.symbol),
n_rates AS ({_RATES.format(fees=s.fees_bps, slip=s.slippage_bps, ret="overnight_return", rows="rets")}),
n_sums AS (SELECT method, night, sum(weight * r) AS gross_return, sum(change) AS turnover, sum(change * coalesce(rate, 0)) AS cost_return, count(*) FILTER (change > 1e-9) AS trade_count,
    count(*) FILTER (abs(weight) > 1e-6) AS positions, sum(weight) AS weight_sum, coalesce(bool_or(fallback), false) AS optimizer_fallback FROM n_both b LEFT JOIN n_rates r ON r.symbol = b.symbol GROUP BY 1, 2),
n_results AS (SELECT s.*, n.date AS signal_date, n.exit_date, greatest(0, 1 - weight_sum) AS cash_weight, gross_return + greatest(0, 1 - weight_sum) * ({s.cash_rate}::DOUBLE / 252) - cost_return AS net_return, weight_sum AS gross_exposure, turnover AS round_trip_turnover
  FROM n_sums s JOIN (SELECT night, date, max(exit_date) AS exit_date FROM n_held GROUP BY night, date) n ON n.night = s.night),
n_daily AS ({_compounded("n_results", str(CAPITAL), "method")})"""


def _night_metrics(s: NightlySettings) -> str:
    return f"""{_nights(s)}
SELECT m.method, observations, start_date, end_date, {", ".join(f"round(m.{x}, 6) AS {x}" for x in re.split(r",\s*", METRICS))}, {_rounded("cost_return_total, average_turnover, average_positions, optimizer_fallback_share", 6)}, optimizer_fallback_days
FROM ({_metrics("n_daily", "method", CAPITAL)}) m JOIN (SELECT method, sum(cost_return) AS cost_return_total, avg(turnover) AS average_turnover, avg(positions) AS average_positions, count(*) FILTER (optimizer_fallback) AS optimizer_fallback_days,
  avg(CASE WHEN optimizer_fallback THEN 1.0 ELSE 0.0 END) AS optimizer_fallback_share FROM n_daily GROUP BY method) e ON e.method = m.method"""


def _night_book(s: NightlySettings, digits: int) -> str:
    return f"{_nights(s)}\nSELECT method, symbol, round(weight, {digits}) AS optimizer_weight, round(overnight_sharpe, {digits}) AS overnight_sharpe, signal_rank FROM n_held WHERE date = (SELECT max(date) FROM n_held)"


def _queries() -> dict[str, str]:
    base, free = queries.PORTFOLIO, books.PORTFOLIO
    capped = replace(base, optimizer=files.CAPPED)
    return {
        "static_portfolios": f"WITH {_static(base)},\n{_daily('s')}{_summary('s', base, 'none')}",
        "static_portfolio_weights": f"WITH {_static(base)}\nSELECT portfolio, symbol, round(weight, 6) AS weight FROM s_weights WHERE abs(weight) > 1e-6",
        "rebalanced_portfolios": f"WITH {_rebalanced(base, 'year')},\n{_daily('r')}{_summary('r', base, 'annually')}",
        "latest_rebalance_dollars": f"WITH {_rebalanced(base, 'year')}\nSELECT portfolio, d.date AS rebalance_date, symbol, round(weight, 4) AS weight, round(weight * {CAPITAL}, 4) AS dollars FROM r_latest w JOIN r_dates d ON d.k = w.k WHERE abs(weight) > 1e-6",
        "custom_portfolio": f"""WITH {_recent(500, True)},\n{_static(base, "d_complete")}
SELECT portfolio, symbol, round(weight, 6) AS weight FROM s_weights WHERE abs(weight) > 1e-6 AND portfolio = (SELECT portfolio FROM s_path GROUP BY portfolio ORDER BY round(stddev_pop(net_return), 14), portfolio LIMIT 1)""",
        "inverse_volatility_portfolio": f"""WITH {_recent(500, False)},\n{_static(capped, "d_complete")}
SELECT portfolio, symbol, round(weight, 4) AS weight, round(weight * {CAPITAL}, 4) AS dollars FROM s_weights WHERE abs(weight) > 1e-6 AND portfolio = 'Inverse Volatility'""",
        "nightly_daily": f"""{_nights(queries.NIGHTLY)}
SELECT CAST(night AS INTEGER) AS night, method, signal_date, exit_date, trade_count, positions, optimizer_fallback, {_by_scale("gross_return, turnover, cost_return, weight_sum, cash_weight, net_return, gross_exposure, round_trip_turnover, ending_equity, starting_equity")} FROM n_daily""",
        "nightly_metrics": _night_metrics(queries.NIGHTLY),
        "nightly_book": _night_book(queries.NIGHTLY, 6),
        "capped_static_weights": f"WITH {_static(free)}\nSELECT portfolio, symbol, round(weight, 7) AS weight FROM s_weights",
        "capped_static_portfolios": f"WITH {_static(free)},\n{_daily('s')}{_summary('s', free, 'none')}",
        "capped_rebalanced_weights": f"WITH {_rebalanced(free, 'quarter')}\nSELECT portfolio, d.date AS rebalance_date, symbol, round(weight, 7) AS weight FROM r_weights w JOIN r_dates d ON d.k = w.k WHERE abs(weight) > 1e-6",
        "capped_rebalanced_portfolios": f"WITH {_rebalanced(free, 'quarter')},\n{_daily('r')}{_summary('r', free, 'quarterly')}",
        "capped_nightly_metrics": _night_metrics(books.NIGHTLY),
        "market_tail_risk": """
WITH tails AS (SELECT 'all' AS run, overnight_return AS r FROM rets WHERE overnight_return IS NOT NULL UNION ALL SELECT CAST(year(date) AS VARCHAR), overnight_return FROM rets WHERE overnight_return IS NOT NULL)
SELECT t.run, round(any_value(v), 9) AS "var", round(avg(CASE WHEN r <= v THEN r END), 9) AS cvar FROM tails t JOIN (SELECT run, quantile_cont(r, 1 - 0.99::DOUBLE) AS v FROM tails GROUP BY run) q ON q.run = t.run GROUP BY t.run""",
        "overnight_features_in_blocks": f"SELECT date, symbol, exit_date, {_rounded('overnight_return, next_overnight_return, overnight_mean, overnight_vol, overnight_sharpe, overnight_win_rate, adv_dollars', 7)} FROM feats",
        "backtest_limited_in_blocks": f"SELECT run, signal_date, exit_date, trade_count, {_by_scale(DAILY)} FROM limited",
        "return_quantiles": " UNION ALL ".join(f"SELECT symbol, {p}::DOUBLE AS share, round(quantile_cont(ret, {p}::DOUBLE), 10) AS quantile FROM est GROUP BY symbol" for p in books.SHARES),
        "capped_nightly_book": _night_book(books.NIGHTLY, 7),
    }


def oracle_sql() -> dict[str, str]:
    return {name: _joined(sql) for name, sql in _queries().items()}
