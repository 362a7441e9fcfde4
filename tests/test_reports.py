"""Reports, sinks, samples and other small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gapbook.functions.columns import market_cap_label
from gapbook.operators import backtest as bt
from gapbook.operators import benchmarks as bm
from gapbook.operators import blotter, costs, nightly, signals
from gapbook.operators import metrics as mx
from gapbook.operators import portfolio as pf
from gapbook.operators import walkforward as wf
from gapbook.sources import bars as sb
from gapbook.sources import reference as ref
from gapbook.sources.sinks import write_report

D = dt.date


def test_sinks_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "report")
    both = spark.createDataFrame([("a", 1), ("b", 2)], "run string, x int")
    write_report(both, path, "csv", ["run"])
    write_report(both.where("run = 'a'").withColumn("x", F.lit(9)), path, "csv", ["run"])
    rows = {r.run: int(r.x) for r in spark.read.option("header", True).csv(path).collect()}
    assert rows == {"a": 9, "b": 2}
    write_report(both, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        write_report(both, path, "xml")


def test_universe_and_membership_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text('symbol,name,sector\n brk.b,"Berkshire, Inc.",Financials\nBRK-B,Other,Energy\nAAPL,Apple,Information Technology\n')
    rows = {r.symbol: r.name for r in ref.read_universe(spark, str(tmp_path / "u.csv")).collect()}
    assert rows == {"BRK-B": "Berkshire, Inc.", "AAPL": "Apple"}
    raw = spark.createDataFrame([("aapl", "2020-01-01", None), ("msft", "never", None), (None, "2020-01-01", None)], "symbol string, start_date string, end_date string")
    assert [r.symbol for r in ref.membership(raw).collect()] == ["AAPL"]
    with pytest.raises(ValueError):
        ref.membership(raw.drop("end_date"))
    with pytest.raises(ValueError):
        ref.universe(raw.drop("symbol"))


def test_quarantined_lines(spark, tmp_path):
    (tmp_path / "b.csv").write_text("symbol,date,open,high,low,close,volume\nA,2024-01-02,1,1,1,1,1\nB,2024-01-02,1,1,1\n")
    assert sb.read_csv(spark, str(tmp_path / "b.csv")).count() == 1
    bad = sb.read_csv(spark, str(tmp_path / "b.csv"), quarantine=True).cache()
    assert [r._corrupt for r in bad.where("_corrupt is not null").collect()] == ["B,2024-01-02,1,1,1"]


def test_vendor_csv(spark):
    frame = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 0.5, 1.5, 10.0)], "Date string, Open double, High double, Low double, Close double, Volume double")
    row = sb.from_vendor_csv(frame, "AAA").first()
    assert (row.date, row.symbol, row.close) == (D(2024, 1, 2), "AAA", 1.5)
    assert frame.select(sb.vendor_symbol(F.lit("brk.b"))).first()[0] == "BRK-B.US"


def test_sample_and_window(spark):
    rows = [(D(2024, 1, k), s, 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(1, 11) for s in "CAB"]
    bars = spark.createDataFrame(rows, sb.BARS)
    got = sb.bounded_sample(bars, 2, 3)
    assert {r.symbol for r in got.collect()} == {"A", "B"} and got.agg(F.min("date")).first()[0] == D(2024, 1, 8)
    only = sb.between(bars, D(2024, 1, 9), None, spark.createDataFrame([(" c",)], "symbol string"))
    assert only.count() == 2 and sb.data_window(only).first().symbols == 1


def test_labels_and_cost_tables(spark):
    caps = spark.createDataFrame([(2.5e12,), (3.21e9,), (4.2e6,), (None,)], "c double")
    assert [r[0] for r in caps.select(market_cap_label("c")).collect()] == ["2.50T", "3.2B", "4M", "-"]
    assert costs.describe_costs(spark, costs.CostSettings()).count() == 1
    assert costs.describe_costs(spark, costs.CostSettings("historical")).count() == 7
    assert bm.registry(spark).count() == 5


def test_orders_and_allocations(spark):
    book = spark.createDataFrame([("A", 0.1234), ("B", 1e-9)], "symbol string, weight double")
    orders = signals.target_orders(book, "signal").collect()
    assert [o.report for o in orders] == ["Would target 12.34%: signal"]
    assert [r.dollars for r in pf.dollar_allocation(book, 1000.0).collect()] == pytest.approx([123.4, 1e-6])


def test_summary_is_enriched_where_it_is_blank(spark):
    weights = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 0.3), ("q", "A", 1.0)], "portfolio string, symbol string, weight double")
    summary = spark.createDataFrame([("p", None), ("q", 0.9), ("r", None)], "portfolio string, weight_sum double")
    got = {r.portfolio: r for r in pf.enriched_summary(summary, weights).collect()}
    assert got["p"].weight_sum == pytest.approx(0.8) and got["p"].cash_weight == pytest.approx(0.2)
    assert got["q"].weight_sum == 0.9 and got["r"].max_weight is None


def test_best_portfolio(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.2), ("b", None, 0.1), ("c", 2.0, 0.3)], "portfolio string, sharpe double, volatility double")
    assert pf.select_best(rows, "sharpe").first().portfolio == "c" == pf.select_best(rows, "unknown").first().portfolio
    assert pf.select_best(rows, "volatility").first().portfolio == "b"


def test_blotter_views(spark):
    rows = [(D(2024, 1, k), D(2024, 1, k + 1), s, 1, 0.5, p, p, 0.0, 10.0) for k, s, p in ((1, "aapl", 5.0), (2, "MSFT", -1.0), (2, "AAPL", 2.0))]
    trades = spark.createDataFrame(rows, "signal_date date, exit_date date, symbol string, signal_rank int, weight double, net_pnl double, gross_pnl double, cost double, notional double")
    assert blotter.filter_trades(trades, symbol=" aap ", pnl="wins").count() == 2
    assert blotter.filter_trades(trades, D(2024, 1, 3), pnl="losses").count() == 1
    s = blotter.trade_summary(trades, trades, 2).first()
    assert (s.latest_trade_count, s.total_net_pnl, s.returned_trades) == (2, 6.0, 2) and s.win_rate == pytest.approx(2 / 3)
    empty = blotter.trade_summary(trades, trades.where("false")).first()
    assert empty.filtered_trades == 0 and empty.total_net_pnl == 0.0 and empty.win_rate is None
    assert [r.symbol for r in blotter.export_order(trades).collect()] == ["aapl", "AAPL", "MSFT"]
    ranked = blotter.export_ranked(trades.repartition(3)).orderBy("export_rank").collect()
    assert [(r.export_rank, r.symbol) for r in ranked] == [(1, "aapl"), (2, "AAPL"), (3, "MSFT")]
    assert blotter.export_ranked(trades.limit(0)).count() == 0


def test_equal_books_and_risk(spark):
    r = spark.createDataFrame([(float(x),) for x in range(-10, 11)] + [(None,)], "ret double")
    got = mx.var_cvar(r, alpha=0.9).first()
    assert got["var"] == pytest.approx(-8.0) and got.cvar == pytest.approx(-9.0)
    none = mx.var_cvar(r.where("false")).first()
    assert (none["var"], none.cvar) == (0.0, 0.0)
    curve = spark.createDataFrame([(D(2010, 1, 1), 1.0, 0.0), (D(2020, 1, 1), 2.0, 0.0)], "date date, equity double, drawdown double")
    assert bt.curve_range(curve, 5).count() == 1
    decay = wf.sharpe_decay(spark.createDataFrame([(1.0,)], "sharpe double"), spark.createDataFrame([(2.0,)], "in_sample_average double")).first()
    assert decay.sharpe_decay == 0.5
    daily = spark.createDataFrame([("cvar", D(2024, 1, 1), 5.0)], "method string, exit_date date, ending_equity double")
    assert nightly.method_curves(daily).columns == ["method", "date", "equity"]


def test_yield_returns_and_refresh(spark):
    rows = [("Y", D(2024, 1, k), c, "yield") for k, c in ((1, 40.0), (2, -1.0), (3, 41.0))]
    got = bm.benchmark_returns(spark.createDataFrame(rows, "key string, date date, close double, kind string")).orderBy("date").collect()
    assert got[0].ret == pytest.approx(0.04 / 365.25) and got[1].ret == pytest.approx(0.04 / 365.25 - 8 * 0.001)
    old = spark.createDataFrame([("K", D(2024, 1, 1), 1.0), ("K", D(2024, 1, 2), 2.0)], "key string, date date, close double")
    new = spark.createDataFrame([("K", D(2024, 1, 2), 9.0), ("K", D(2024, 1, 3), 3.0)], old.schema)
    assert [r.close for r in bm.refresh_closes(old, new).orderBy("date").collect()] == [1.0, 2.0, 3.0]
