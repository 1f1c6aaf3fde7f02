"""Registered queries against their check SQL on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KEYS = [
    "scan_candles", "decode_market_chart", "upsert_candles", "discover_delisted", "resolve_ids", "running_extrema",
    "dip_zone_visits", "candle_coverage", "asof_rate_clamp", "lagged_prices", "coin_stats", "rank_percentiles",
    "threshold_alerts", "stream_candles", "stream_alerts", "hidden_reasons",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    cursor = con.execute(entry.oracle_sql()[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, df.collect()) == normal(columns, cursor.fetchall())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "metric", "mode"]
    assert df.count() >= 0
