"""Saved strategies: every way to be broken gives a row its error, and no row stops another."""

from tidemark.operators.signals import decode_strategies
from tidemark.plans.presets import DEFAULTS


def test_broken_strategies_are_rows_with_errors(spark):
    cases = {
        "good": ('{"top_n": 2, "min_score": 61.5, "frequency": "monthly", "ic_filter": true}', None),
        "defaults": ("{}", None),
        "off": ('{"max_market_cap": null}', None),
        "no_json": ("{top_n: ", "not a JSON object"),
        "null": (None, "not a JSON object"),
        "unknown": ('{"leverage": 3, "alpha": 1}', "unknown parameter: alpha, leverage"),
        "type": ('{"top_n": "many", "ic_filter": "perhaps"}', "wrong type: top_n, ic_filter"),
        "word": ('{"weighting": "random", "rotation": "never"}', "illegal value: weighting, rotation"),
        "slots": ('{"top_n": 0}', "illegal value: top_n"),
        "refused": ('{"stop_loss_pct": 10}', "rule the book does not apply: stop_loss_pct"),
        "held": ('{"rotation": "hold", "max_holding_periods": 3}', None),
    }
    rows = {r.strategy_id: r for r in decode_strategies(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "strategy_id string, params string")).collect()}
    assert {k: r.error for k, r in rows.items()} == {k: e for k, (_, e) in cases.items()}
    good = rows["good"]
    assert (good.top_n, good.min_score, good.frequency, good.ic_filter) == (2, 61.5, "monthly", True)
    assert all(rows["defaults"][n] == d for n, (_, d) in DEFAULTS.items()) and rows["off"].max_market_cap is None


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "strategy_id string, params string")
    assert decode_strategies(none).count() == 0
