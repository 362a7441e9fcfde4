"""SQL for portfolio weights: each method of the suite worked out again in lists, step by step.

A problem is a key ``k`` with complete rows ``k, date, symbol, ret``. Matrices are lists of rows in the
order of symbols. Iterations are recursive queries over all problems and methods at once.
"""

from __future__ import annotations

from gapbook.operators.optimizers import JITTER, SUITE, TINY, OptimizerSettings

#: Steps of the minimum variance that stands in where no growth-optimal weight is positive.
KELLY_ITERATIONS = 750


def projection(source: str, keys: str) -> str:
    """``source`` (keys, v, cap, total) with ``w``, the nearest point of v between 0 and the cap that sums to
    the total: the sum as a function of the shift is a line between the places where an entry starts or
    stops to grow."""
    return f"""
  SELECT {keys}, list_transform(v, lambda z: greatest(0.0, least(cap, z - t))) AS w FROM (
    SELECT *, CASE WHEN lo IS NULL THEN hi.p WHEN lo.s > hi.s THEN lo.p + (lo.s - total) / (lo.s - hi.s) * (hi.p - lo.p) ELSE lo.p END AS t FROM (
      SELECT *, list_max(list_filter(ps, lambda q: q.s >= total)) AS lo, list_min(list_filter(ps, lambda q: q.s <= total)) AS hi FROM (
        SELECT *, list_transform(list_concat(v, list_transform(v, lambda z: z - cap)), lambda p: {{'p': p, 's': list_sum(list_transform(v, lambda z: greatest(0.0, least(cap, z - p))))}}) AS ps FROM ({source}))))"""


def _plus_diagonal(matrix: str, what: str) -> str:
    return f"list_transform({matrix}, lambda row, i: list_transform(row, lambda entry, j: entry + CASE WHEN i = j THEN {what} ELSE 0.0 END))"


def _times(matrix: str, vector: str) -> str:
    return f"list_transform({matrix}, lambda row: list_dot_product(row, {vector}))"


def suite(rows: str, s: OptimizerSettings, p: str = "s") -> str:
    """Steps from ``rows`` (k, date, symbol, ret) to ``{p}_weights``: k, portfolio, symbol, weight."""
    cap = 1.0 if s.max_weight is None else s.max_weight
    # one cap for all methods; what it allows in all
    whole = f"least(1.0::DOUBLE, {cap}::DOUBLE * n)"
    kelly, mean_variance, minimum, inverse, cvar, litterman = SUITE
    return f"""
{p}_days AS (SELECT k, date, list(ret ORDER BY symbol) AS r, list(symbol ORDER BY symbol) AS syms FROM {rows} GROUP BY k, date),
{p}_x AS (SELECT k, list(r ORDER BY date) AS x, any_value(syms) AS syms, any_value(len(syms)) AS n, count(*) AS rows FROM {p}_days GROUP BY k),
{p}_mu AS (SELECT k, list(m ORDER BY symbol) AS mu FROM (
  SELECT r.k, r.symbol, avg(least(greatest(ret, a), b)) AS m FROM {rows} r JOIN (SELECT k, symbol, quantile_cont(ret, 0.02) AS a, quantile_cont(ret, 0.98) AS b FROM {rows} GROUP BY k, symbol) q ON q.k = r.k AND q.symbol = r.symbol GROUP BY 1, 2) GROUP BY k),
{p}_centred AS (SELECT k, x, syms, n, rows, list_transform(range(1, n + 1), lambda j: list_transform(x, lambda r: r[j] - list_avg(list_transform(x, lambda y: y[j])))) AS cols FROM {p}_x),
{p}_plain AS (SELECT * EXCLUDE (cols), list_transform(cols, lambda a: list_transform(cols, lambda b: list_dot_product(a, b) / (rows - 1))) AS c FROM {p}_centred),
{p}_cov AS (SELECT * REPLACE ({_plus_diagonal("c", "greatest(list_avg(list_transform(c, lambda line, d: line[d])) * 1e-8, 1e-10)")} AS c) FROM {p}_plain),
{p}_firm AS (SELECT v.*, m.mu, {_plus_diagonal("c", f"{JITTER}")} AS c1, {_plus_diagonal("c", f"{2 * JITTER}")} AS c2 FROM {p}_cov v JOIN {p}_mu m ON m.k = v.k),
{p}_square AS (
  SELECT k, 0 AS it, c1 AS power FROM {p}_firm
  UNION ALL
  SELECT k, it + 1, list_transform(square, lambda row: list_transform(row, lambda y: y / list_sum(list_transform(square, lambda z, i: z[i])))) FROM (
    SELECT k, it, list_transform(power, lambda a: list_transform(power, lambda b: list_dot_product(a, b))) AS square FROM {p}_square WHERE it < 40)),
{p}_top AS (SELECT q.k, greatest({TINY}, list_sum(list_transform(power, lambda row, i: list_dot_product(row, c1[i]))) / list_sum(list_transform(power, lambda row, i: row[i]))) AS top FROM {p}_square q JOIN {p}_firm f ON f.k = q.k WHERE it = 40),
{p}_solve AS (
  SELECT k, 0 AS it, n, list_transform(c1, lambda row, i: list_append(row, mu[i])) AS a FROM {p}_firm
  UNION ALL
  SELECT k, it + 1, n, list_transform(a, lambda row, i: CASE WHEN i = it + 1 THEN list_transform(row, lambda y: y / row[it + 1]) ELSE list_transform(row, lambda y, j: y - row[it + 1] * a[it + 1][j] / a[it + 1][it + 1]) END) FROM {p}_solve WHERE it < n),
{p}_growth AS (SELECT k, list_transform(a, lambda row: greatest(row[n + 1], 0.0)) AS v FROM {p}_solve WHERE it = n),
{p}_prior AS (SELECT k, list_transform(c, lambda row: {s.bl_prior_risk}::DOUBLE * list_sum(row) / n) AS b FROM {p}_firm),
{p}_problems AS (
  SELECT f.k, '{mean_variance}' AS portfolio, c1 AS c, {s.risk_aversion}::DOUBLE AS a, mu AS b, 1 / ({s.risk_aversion}::DOUBLE * top + {TINY}) AS step, n, {s.iterations} AS most FROM {p}_firm f JOIN {p}_top t ON t.k = f.k
  UNION ALL SELECT f.k, '{minimum}', c1, 2.0::DOUBLE, list_transform(mu, lambda m: 0.0::DOUBLE), 1 / (2 * top + {TINY}), n, {s.iterations} FROM {p}_firm f JOIN {p}_top t ON t.k = f.k
  UNION ALL SELECT f.k, '{litterman}', c1, {s.bl_risk_aversion}::DOUBLE, b, 1 / ({s.bl_risk_aversion}::DOUBLE * top + {TINY}), n, {s.iterations} FROM {p}_firm f JOIN {p}_top t ON t.k = f.k JOIN {p}_prior r ON r.k = f.k
  UNION ALL SELECT f.k, '{kelly}', c2, 2.0::DOUBLE, list_transform(mu, lambda m: 0.0::DOUBLE), 1 / (2 * (top + {JITTER}) + {TINY}), n, {KELLY_ITERATIONS} FROM {p}_firm f JOIN {p}_top t ON t.k = f.k JOIN {p}_growth g ON g.k = f.k WHERE list_sum(v) <= 0),
{p}_descent AS (
  SELECT k, portfolio, 0 AS it, list_transform(b, lambda m: 1.0::DOUBLE / n) AS w FROM {p}_problems
  UNION ALL {projection(f'''
    SELECT d.k, d.portfolio, d.it + 1 AS it, {cap}::DOUBLE AS cap, {whole} AS total, list_transform(c, lambda row, i: w[i] - step * (a * list_dot_product(row, w) - b[i])) AS v
    FROM {p}_descent d JOIN {p}_problems q ON q.k = d.k AND q.portfolio = d.portfolio WHERE d.it < q.most''', "k, portfolio, it")}),
{p}_even AS ({projection(f"SELECT k, {cap}::DOUBLE AS cap, {whole} AS total, list_transform(c, lambda row, i: 1 / sqrt(greatest(row[i], 1e-12))) AS v FROM {p}_firm", "k")}),
{p}_kelly AS ({projection(f"SELECT f.k, {cap}::DOUBLE AS cap, least({s.kelly_fraction}::DOUBLE, {cap}::DOUBLE * n) AS total, v FROM {p}_firm f JOIN {p}_growth g ON g.k = f.k WHERE list_sum(v) > 0", "k")}),
{p}_tail AS (
  SELECT k, 0 AS it, w FROM {p}_even
  UNION ALL {projection(f'''
    SELECT k, it + 1 AS it, {cap}::DOUBLE AS cap, {whole} AS total,
      list_transform(w, lambda y, j: y + 0.15 / sqrt(it + 1) * list_avg(list_transform(worst, lambda day: day[j]))) AS v FROM (
      SELECT k, it, w, n, list_filter(x, lambda day: list_dot_product(day, w) <= low + part * (high - low)) AS worst FROM (
        SELECT k, it, w, n, x, part, sorted[below + 1] AS low, sorted[least(below + 1, rows - 1) + 1] AS high FROM (
          SELECT t.k, t.it, t.w, c.n, c.x, c.rows, list_sort({_times("c.x", "t.w")}) AS sorted, CAST(floor((1 - {s.cvar_alpha}::DOUBLE) * (c.rows - 1)) AS BIGINT) AS below,
            (1 - {s.cvar_alpha}::DOUBLE) * (c.rows - 1) - floor((1 - {s.cvar_alpha}::DOUBLE) * (c.rows - 1)) AS part
          FROM {p}_tail t JOIN {p}_x c ON c.k = t.k WHERE t.it < {s.cvar_iterations})))''', "k, it")}),
{p}_lists AS (
  SELECT d.k, d.portfolio, w FROM {p}_descent d JOIN {p}_problems q ON q.k = d.k AND q.portfolio = d.portfolio WHERE it = most
  UNION ALL SELECT k, '{inverse}', w FROM {p}_even
  UNION ALL SELECT k, '{kelly}', w FROM {p}_kelly
  UNION ALL SELECT k, '{cvar}', w FROM {p}_tail WHERE it = {s.cvar_iterations}),
{p}_weights AS (SELECT l.k, portfolio, unnest(syms) AS symbol, unnest(w) AS weight FROM {p}_lists l JOIN {p}_x x ON x.k = l.k)"""


def _rates(rows: str, fees: float, slip: float) -> str:
    return f"""
  SELECT k, symbol, {fees} / 10000 + {slip} / 10000 * CASE WHEN m IS NULL THEN 1.0 ELSE greatest(0.25, least(4.0, v / m)) END AS rate
  FROM (SELECT *, avg(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY k) AS m FROM (SELECT k, symbol, stddev_pop(ret) AS v FROM {rows} GROUP BY k, symbol))"""


def static(rows: str, s: OptimizerSettings, fees: float, slip: float, p: str = "s") -> str:
    """Steps from ``rows`` (date, symbol, ret) to ``{p}_weights`` and daily results ``{p}_path``."""
    return f"""{p}_rows AS (SELECT 0 AS k, * FROM {rows}),{suite(f"{p}_rows", s, p)},
{p}_rates AS ({_rates(f"{p}_rows", fees, slip)}),
{p}_held AS (SELECT w.portfolio, c.date, w.weight, c.ret, r.rate, sum(w.weight * c.ret) OVER (PARTITION BY w.portfolio, c.date) AS port, c.date = min(c.date) OVER (PARTITION BY w.portfolio) AS opening
  FROM {p}_weights w JOIN {p}_rows c ON c.symbol = w.symbol JOIN {p}_rates r ON r.symbol = w.symbol),
{p}_moved AS (SELECT *, CASE WHEN opening THEN abs(weight) ELSE abs(weight * (1 + ret) / (1 + port) - weight) END AS trade FROM {p}_held),
{p}_path AS (SELECT *, gross_return - cost_return AS net_return FROM (SELECT portfolio, date AS signal_date, date AS exit_date, any_value(port) AS gross_return, sum(trade * rate) AS cost_return, sum(abs(weight)) AS gross_exposure,
  count(*) FILTER (abs(weight) > 1e-6) AS trade_count, sum(trade) AS round_trip_turnover FROM {p}_moved GROUP BY portfolio, date))"""


def rebalanced(rows: str, s: OptimizerSettings, period: str, lookback: int, fees: float, slip: float, p: str = "r") -> str:
    """Steps from ``rows`` (date, symbol, ret) to ``{p}_weights`` (k the rebalance), ``{p}_dates`` and
    ``{p}_path``; rebalances at the first date of each period from ``lookback`` dates on."""
    return f"""{p}_cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM {rows})),
{p}_dates AS (SELECT *, row_number() OVER (ORDER BY date) AS k, lead(date) OVER (ORDER BY date) AS until FROM (SELECT min(date) AS date, min(pos) AS pos FROM {p}_cal WHERE pos >= {lookback} GROUP BY date_trunc('{period}', date))),
{p}_rows AS (SELECT d.k, c.date, c.symbol, c.ret FROM {rows} c JOIN {p}_cal l ON l.date = c.date JOIN {p}_dates d ON l.pos < d.pos AND l.pos >= d.pos - {lookback}),{suite(f"{p}_rows", s, p)},
{p}_rates AS ({_rates(f"{p}_rows", fees, slip)}),
{p}_changed AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY portfolio, symbol ORDER BY k), 0)) AS change FROM {p}_weights),
{p}_held AS (SELECT w.k, w.portfolio, c.date, w.weight, w.change, c.ret, r.rate, sum(w.weight * c.ret) OVER (PARTITION BY w.portfolio, c.date) AS port, c.date = min(c.date) OVER (PARTITION BY w.portfolio, w.k) AS opening
  FROM {p}_dates d JOIN {rows} c ON c.date >= d.date AND (d.until IS NULL OR c.date < d.until) JOIN {p}_changed w ON w.k = d.k AND w.symbol = c.symbol JOIN {p}_rates r ON r.k = w.k AND r.symbol = w.symbol),
{p}_moved AS (SELECT *, CASE WHEN opening THEN change ELSE abs(weight * (1 + ret) / (1 + port) - weight) END AS trade FROM {p}_held),
{p}_path AS (SELECT *, gross_return - cost_return AS net_return FROM (SELECT portfolio, date AS signal_date, date AS exit_date, any_value(port) AS gross_return, sum(trade * rate) AS cost_return, sum(abs(weight)) AS gross_exposure,
  count(*) FILTER (abs(weight) > 1e-6) AS trade_count, sum(trade) AS round_trip_turnover FROM {p}_moved GROUP BY portfolio, date)),
{p}_turns AS (SELECT portfolio, count(*) AS rebalance_count, coalesce(avg(CASE WHEN t > 1e-9 THEN t END), 0) AS average_turnover, max(date) AS last_rebalance_date
  FROM (SELECT c.portfolio, c.k, sum(change) AS t, any_value(d.date) AS date FROM {p}_changed c JOIN {p}_dates d ON d.k = c.k GROUP BY 1, 2) GROUP BY portfolio),
{p}_latest AS (SELECT * FROM {p}_weights WHERE k = (SELECT max(k) FROM {p}_dates))"""
