import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.operators import strategy as J
from tidemark.operators.calendar import Calendar
from tidemark.plans.presets import strategies
from tidemark.plans.space import sample_strategies

DAYS = [dt.date(2023, m, 1) for m in (1, 2, 3, 4)]
SCORES = {"AAA": [90, 45, 35, 30], "BBB": [30, 80, 85, 90]}
PRICES = {"AAA": [100.0, 110.0, 120.0, 130.0], "BBB": [100.0] * 4}
BASE = {
    "frequency": "monthly", "top_n": 1, "min_score": 50.0, "min_market_cap": 0.0, "min_volume": 0.0,
    "fill_with_btc": False, "fee_pct": 0.0,
}


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        ("monthly", d, s, float(SCORES[s][i]), 0.0, PRICES[s][i], 1e9, 1e8, None)
        for s in SCORES for i, d in enumerate(DAYS)
    ]
    panel = spark.createDataFrame(
        rows, "frequency string, anchor date, symbol string, score double, distance double, price double, cap double, volume double, trend_30d double"
    )
    regime = spark.createDataFrame(
        [("monthly", d, i, flag, b) for i, (d, flag, b) in enumerate(zip(DAYS, [True, False, True, True], [0.8, 0.2, 0.6, 0.6]))],
        "frequency string, anchor date, idx int, alt_above_sma boolean, breadth double",
    )
    dip = {"AAA": 105.0, "BBB": 60.0}
    candles = spark.createDataFrame(
        [(s, d + dt.timedelta(days=10), dip[s]) for s in SCORES for d in DAYS], "symbol string, ts date, close double"
    )
    return panel, regime, candles, Calendar("monthly", DAYS[0], DAYS[-1])


def run(spark, world, **configs):
    """Weights per strategy and anchor, and the last equity of each strategy."""
    panel, regime, _, cal = world
    table = strategies(spark, {k: {**BASE, **v} for k, v in configs.items()})
    held = J.book(panel, regime, table, cal)
    curve = J.equity_curve(J.periods(held, panel, table, cal)).toPandas().sort_values("idx")
    weights = {}
    for r in held.collect():
        if r.weight:
            weights.setdefault(r.strategy_id, {}).setdefault(r.idx, {})[r.symbol] = r.weight
    return weights, curve.groupby("strategy_id").equity.last().to_dict()


def test_rotation_modes(spark, world):
    weights, _ = run(
        spark,
        world,
        keep={"rotation": "hold", "sell_score": 30.0},
        drop={"rotation": "hold", "sell_score": 40.0},
        default={"rotation": "hold"},
        swap={},
    )
    assert weights["keep"] == {0: {"AAA": 1.0}, **{i: {"AAA": 0.5, "BBB": 0.5} for i in (1, 2, 3)}}
    assert weights["drop"] == {0: {"AAA": 1.0}, 1: {"AAA": 0.5, "BBB": 0.5}, 2: {"BBB": 1.0}, 3: {"BBB": 1.0}}
    assert weights["default"] == weights["swap"] == {0: {"AAA": 1.0}, **{i: {"BBB": 1.0} for i in (1, 2, 3)}}


def test_regime_empties_the_book(spark, world):
    weights, _ = run(spark, world, trend={"regime_filter": "alt_trend"}, wide={"regime_filter": "breadth", "regime_min_breadth": 0.1})
    assert sorted(weights["trend"]) == [0, 2, 3] and sorted(weights["wide"]) == [0, 1, 2, 3]


def test_equity_compounds_and_shorts_earn_on_falls(spark, world):
    _, equity = run(spark, world, fee={"fee_pct": 1.0}, short={"short_n": 1, "min_score": 101.0})
    # January buys at 1 %, February swaps the whole book at 2 %, March trades nothing.
    assert abs(equity["fee"] - (1.1 - 0.01) * (1 - 0.02)) < 1e-12
    # Shorts: BBB in January (flat), AAA afterwards.
    assert abs(equity["short"] - (1 - (120 / 110 - 1)) * (1 - (130 / 120 - 1))) < 1e-12


@pytest.mark.parametrize("rule", J.EXIT_RULES + J.EQUITY_RULES)
def test_the_book_refuses_rules_it_does_not_apply(spark, world, rule):
    value = 5 if rule == "max_holding_periods" else 5.0
    with pytest.raises(ValueError, match=rule):
        run(spark, world, x={rule: value})
    if rule in J.DAILY_RULES + J.EQUITY_RULES:
        with pytest.raises(ValueError, match=rule):
            run(spark, world, x={rule: value, "rotation": "hold"})


def one_symbol(spark, prices, scores=None, closes=()):
    """A world of one symbol with monthly prices, its scores (default: always a candidate) and daily closes (day, close)."""
    days = [dt.date(2023, m + 1, 1) for m in range(len(prices))]
    rows = [("monthly", d, "AAA", float(s), 0.0, p, 1e9, 1e8, None) for d, p, s in zip(days, prices, scores or [90] * len(days)) if s is not None]
    panel = spark.createDataFrame(rows, "frequency string, anchor date, symbol string, score double, distance double, price double, cap double, volume double, trend_30d double")
    regime = spark.createDataFrame([("monthly", d, i, True, 0.8) for i, d in enumerate(days)], "frequency string, anchor date, idx int, alt_above_sma boolean, breadth double")
    candles = spark.createDataFrame([("AAA", d, c) for d, c in closes], "symbol string, ts date, close double")
    return panel, regime, candles, Calendar("monthly", days[0], days[-1])


def held(spark, world, **config):
    panel, regime, candles, cal = world
    table = strategies(spark, {"x": {**BASE, "rotation": "hold", **config}})
    book = J.book(panel, regime, table, cal, candles)
    curve = J.equity_curve(J.periods(book, panel, table, cal)).toPandas().sort_values("idx")
    return {r.idx: round(r.weight, 6) for r in book.collect()}, curve.equity.tolist()


def test_time_limit_blocks_one_anchor_and_lets_in_again(spark):
    weights, _ = held(spark, one_symbol(spark, [100.0] * 7), max_holding_periods=2)
    assert sorted(weights) == [0, 1, 4, 5]
    weights, _ = held(spark, one_symbol(spark, [100.0] * 8, [90, 90, 90, 90, 40, 40, 90, 90]), max_holding_periods=2, sell_score=30.0)
    assert sorted(weights) == [0, 1, 6, 7]  # free again at 4, but a candidate only at 6


def test_stop_ends_the_period_and_blocks_the_next_anchor(spark):
    closes = [(dt.date(2023, 1, 2), 95.0), (dt.date(2023, 1, 3), 74.0), (dt.date(2023, 1, 20), 90.0), (dt.date(2023, 2, 10), 60.0), (dt.date(2023, 3, 5), 90.0)]
    weights, equity = held(spark, one_symbol(spark, [100.0, 85.0, 80.0, 88.0, 88.0], closes=closes), stop_loss_pct=25.0)
    assert sorted(weights) == [0, 2, 3, 4]
    assert [round(e, 9) for e in equity] == [1.0, 0.74, 0.74, round(0.74 * 1.1, 9), round(0.74 * 1.1, 9)]


def test_levels_follow_the_entry_and_the_peak_across_periods(spark):
    closes = [(dt.date(2023, 1, 15), 150.0), (dt.date(2023, 2, 15), 110.0), (dt.date(2023, 2, 20), 104.0)]
    world = one_symbol(spark, [100.0, 120.0, 118.0, 118.0], closes=closes)
    paths = J.position_paths(world[0], strategies(spark, {"x": {**BASE, "rotation": "hold", "trailing_stop_pct": 30.0}}), world[2], world[3])
    exits = [(r.idx, r.ts, r.price, r.peak, r.reason) for r in paths.filter("kind = 'exit'").collect()]
    assert exits == [(1, dt.date(2023, 2, 20), 104.0, 150.0, "trailing_stop")]
    assert [(r.idx, r.symbol) for r in J.blocked_union(paths).collect()] == [(2, "AAA")]


def test_sweeps_shrink_a_position_for_good(spark):
    weights, _ = held(spark, one_symbol(spark, [100.0, 110.0, 121.0, 100.0]), profit_sweep_pct=50.0)
    first = 1 - 0.5 * (0.1 / 1.1)
    second = first * (1 - 0.5 * (0.21 / 1.21))
    assert weights == {0: 1.0, 1: round(first, 6), 2: round(second, 6), 3: round(second, 6)}


def test_missing_rows_end_a_position(spark):
    weights, _ = held(spark, one_symbol(spark, [100.0] * 5, [90, None, 40, 90, 40]), max_holding_periods=9, sell_score=30.0)
    assert sorted(weights) == [0, 3, 4]


def test_live_book_lists_nothing_when_flat_and_trails_daily_closes(spark, world):
    panel, regime, _, cal = world
    table = strategies(spark, {"held": {**BASE, "rotation": "hold", "sell_score": 0.0}, "flat": {**BASE, "min_score": 101.0}})
    table = table.withColumn("trailing_stop_pct", F.lit(50.0))
    candles = spark.createDataFrame([("AAA", DAYS[0], 100.0), ("AAA", DAYS[1] + dt.timedelta(days=9), 200.0), ("AAA", DAYS[3], 130.0)], "symbol string, ts date, close double")
    plain = strategies(spark, {"held": {**BASE, "rotation": "hold", "sell_score": 0.0}, "flat": {**BASE, "min_score": 101.0}})
    rows = S.live_positions(J.book(panel, regime, plain, cal), panel, candles, table, cal, DAYS[-1]).collect()
    found = {(r.strategy_id, r.symbol): (r.peak, r.trailing_stop_price) for r in rows}
    assert found["held", "AAA"] == (200.0, 100.0) and not any(k[0] == "flat" for k in found)


def test_unknown_parameter_is_rejected(spark):
    with pytest.raises(ValueError):
        strategies(spark, {"x": {"leverage": 3}})


def test_sampled_trials_differ_and_are_as_many_as_asked(spark):
    names = ["top_n", "weighting", "rotation"]
    everything = 9 * 3 * 2
    rows = sample_strategies(spark, names, everything, 5, "monthly").select(*names).collect()
    assert len({tuple(r) for r in rows}) == len(rows) == everything
    some = [tuple(r) for r in sample_strategies(spark, names, 20, 5, "monthly").select(*names).collect()]
    assert some == [tuple(r) for r in rows[:20]] and some != [tuple(r) for r in sample_strategies(spark, names, 20, 6, "monthly").select(*names).collect()]
    with pytest.raises(ValueError):
        sample_strategies(spark, names, everything + 1, 5, "monthly")
