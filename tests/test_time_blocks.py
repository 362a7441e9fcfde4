"""Windows over blocks of time against windows over whole series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapbook.operators import features as ft
from gapbook.operators import time_blocks as tb


@pytest.fixture(scope="module")
def bars(spark):
    """One symbol with most bars, one with a few, one with a single bar."""
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in (("HOT", 700), ("FEW", 30), ("ONE", 1)):
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (n, 2)).ravel())).reshape(n, 2)
        rows += [(dt.date(2000, 1, 1) + dt.timedelta(k), symbol, float(o), float(max(o, c)), float(min(o, c)), float(c), float(rng.integers(1, 1000))) for k, (o, c) in enumerate(p)]
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double").repartition(4)


@pytest.mark.parametrize("rows", [22, 64, 10_000])
def test_features_of_blocks_equal_those_of_series(bars, rows):
    s = ft.FeatureSettings(21, 13)
    whole = {(r.symbol, r.date): r.asDict() for r in ft.build_features(bars, s).collect()}
    cut = ft.build_features_in_blocks(bars, s, rows)
    found = {(r.symbol, r.date): r.asDict() for r in cut.collect()}
    assert whole.keys() == found.keys() and set(cut.columns) == set(next(iter(whole.values())))
    for k, own in whole.items():
        for c, v in own.items():
            assert found[k][c] == (pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float) else v), (k, c)


def test_a_long_series_is_in_many_blocks(bars):
    cut = tb.in_blocks(bars, "symbol", "date", 50, 20, 1)
    own = {(r.symbol, r._block): (r.n, r.halo) for r in cut.groupBy("symbol", "_block").agg(F.count_if(~F.col("_halo")).alias("n"), F.count_if("_halo").alias("halo")).collect()}
    assert [own["HOT", k] for k in range(15)] == [(50, 1), *[(50, 21)] * 12, (50, 20), (0, 20)]
    assert own["ONE", 0] == (1, 0)
    assert tb.in_blocks(bars.limit(0), "symbol", "date", 50, 20, 1).count() == 0
    with pytest.raises(ValueError, match="halo"):
        tb.in_blocks(bars, "symbol", "date", 5, 20, 1)
