"""The entry module: what it registers, and queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(str(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", ["bars_cleaned", "overnight_features", "overnight_signals", "member_bars", "backtest_daily", "performance", "era_study"])
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = plain(tuple(r) for r in frame.select(*columns).collect())
    found = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == plain(found)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
