"""Candles from raw trades: the ends of a day, and what a task holds."""

import datetime as dt
import tempfile

from tidemark.sources import fixtures as fx

DAY = dt.datetime(2000, 1, 3)
LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"


def folder(spark, lines):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(lines, LINE).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, None, "x")], "p_partkey bigint, p_brand string, p_type string").write.parquet(f"{path}/part.parquet")
    return path


def test_ends_of_a_day_by_the_whole_trade_key(spark):
    lines = [
        (5, 1, 1, 2, 1.0, 10.0, DAY), (5, 1, 1, 1, 1.0, 11.0, DAY), (5, 1, 0, 1, 2.0, 24.0, DAY),  # one order, three lines
        (9, 2, 1, 1, 1.0, 20.0, DAY), (None, 2, 1, 1, 1.0, 21.0, DAY), (7, 2, 1, 1, 1.0, 22.0, DAY),  # a missing order is first
        (5, 2, 1, 1, 1.0, 30.0, DAY + dt.timedelta(days=1)),
        (4, 3, 1, 1, 1.0, 40.0, None), (6, 3, 1, 1, 1.0, 41.0, None),  # neither symbol nor day
        (8, 99, 1, 1, 1.0, 50.0, DAY),  # no such part
    ]
    rows = {(r.symbol, r.ts): (r.open, r.close, r.high, r.low, r.volume, r.notional) for r in fx.candles(spark, folder(spark, lines)).collect()}
    first, second = DAY.date(), DAY.date() + dt.timedelta(days=1)
    assert rows == {
        ("A", first): (12.0, 10.0, 12.0, 10.0, 4.0, 45.0),
        ("B", first): (21.0, 20.0, 22.0, 20.0, 3.0, 63.0),
        ("B", second): (30.0, 30.0, 30.0, 30.0, 1.0, 30.0),
        (None, None): (40.0, 41.0, 41.0, 40.0, 2.0, 81.0),
    }


def test_no_raw_row_is_sorted(spark):
    path = folder(spark, [(i, 1 + i % 2, 1, 1, 1.0, 10.0 + i, DAY) for i in range(50)])
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert len(fx.candles(spark, path).collect()) == 2
    plans = [e.physicalPlanDescription() for e in (store.executionsList().apply(i) for i in range(before, store.executionsCount()))]
    reads = [p for p in plans if "lineitem" in p]
    assert reads
    for plan in reads:  # an aggregate that sorts its input sees the trades at the ends of a day only
        assert "SortAggregate" not in plan or "LeftSemi" in plan
