"""Research on overnight equity returns as Spark jobs: bars, features, signals, backtests, metrics,
benchmarks, cost eras, walk-forward evaluation and portfolio construction."""
