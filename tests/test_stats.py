import datetime as dt
import random

import pytest

from tests.naive import stats as naive_stats
from tidemark.operators.calendar import Calendar
from tidemark.operators.lookback import lookback_stats

START = dt.date(2015, 1, 1)
SCHEMA = "symbol string, ts date, close double, low double, volume double"


def candles(spark, series, lows=None):
    rows = []
    for symbol, closes in series.items():
        for i, c in enumerate(closes):
            low = lows[symbol][i] if lows else c
            rows.append((symbol, START + dt.timedelta(days=i), float(c), float(low), 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def at_end(spark, series, **kw):
    last = START + dt.timedelta(days=max(len(s) for s in series.values()))
    frame = lookback_stats(candles(spark, series, **kw), Calendar.once(last))
    return {r["symbol"]: r.asDict() for r in frame.collect()}


def test_closed_form_series(spark):
    series = {
        "ramp": list(range(1, 201)),
        "step": [100.0] * 110 + [10.0] * 90,
        "waves": ([200.0] * 10 + [80.0] * 40) * 4,
        "falling": [100 - 0.25 * i for i in range(200)],
        "weak": [150.0] * 60 + [100.0] * 60 + [120.0] * 80,
        "short": [1.0, 2.0, 3.0],
    }
    got = at_end(spark, series)
    ramp = got["ramp"]
    assert (ramp["valuation_pct_1y"], ramp["valuation_pct_all"], ramp["valuation_pct_3y"]) == (100.0, 100.0, None)
    assert (ramp["median_dist_1y"], ramp["range_position"], ramp["days_since_atl"], ramp["trend_30d"]) == (99.0, 1.0, 199, 17.6)
    assert ramp["above_sma200"] is True
    step = got["step"]
    assert (step["basing_pct_90d"], step["median_dist_1y"], step["range_position"], step["days_since_atl"]) == (100.0, -90.0, 0.0, 89)
    assert (got["falling"]["dip_touches"], got["falling"]["dip_bounces"]) == (1, 0)
    assert (got["weak"]["dip_touches"], got["weak"]["dip_bounces"], got["weak"]["dip_bounce_avg"]) == (0, 0, None)
    assert got["short"]["valuation_pct_1y"] is None and got["short"]["trend_7d"] is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_the_definitions_at_every_anchor(spark, seed):
    rng = random.Random(seed)
    series, lows = {}, {}
    for k, n in enumerate((90, 200, 700, 1500)):
        price, closes = 100.0, []
        for _ in range(n):
            price = max(1.0, price * (1 + rng.gauss(0, 0.06)) if rng.random() < 0.9 else price)
            closes.append(round(price, 1))
        series[f"s{k}"] = closes
        lows[f"s{k}"] = [c - rng.random() for c in closes]
    cal = Calendar.between("monthly", START, START + dt.timedelta(days=1520))
    rows = lookback_stats(candles(spark, series, lows), cal).collect()
    assert len(rows) > 120
    for r in rows:
        seen = min((r["anchor"] - START).days + 1, len(series[r["symbol"]]))
        want = naive_stats(series[r["symbol"]][:seen], lows[r["symbol"]][:seen])
        assert {k: r[k] for k in want} == want, (r["symbol"], r["anchor"])


def test_old_anchors_do_not_change_when_the_future_arrives(spark):
    rng = random.Random(5)
    closes = [100 * (1 + 0.5 * rng.random()) for _ in range(900)]
    cal = Calendar.between("weekly", START + dt.timedelta(days=400), START + dt.timedelta(days=599))
    old = lookback_stats(candles(spark, {"a": closes[:600]}), cal).orderBy("anchor").collect()
    new = lookback_stats(candles(spark, {"a": closes}), cal).orderBy("anchor").collect()
    assert old == new and len(old) > 20


def test_rounding_follows_the_exact_binary_value(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.numeric import round1

    values = [0.25, 0.15, 0.35, 12.35, 12.45, -0.25, 0.75, 2.5, 1.05, 99.95, 1e5 + 0.05]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", round1(F.col("x")).alias("r")).collect()
    assert {r["x"]: r["r"] for r in rows} == {v: round(v, 1) for v in values}
