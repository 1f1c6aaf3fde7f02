"""Strategy tables: defaults and named presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Strategy parameters, their types and their defaults.
DEFAULTS: dict[str, tuple[str, object]] = {
    "frequency": ("string", "weekly"),
    "top_n": ("int", 5),
    "min_score": ("double", 50.0),
    "min_market_cap": ("double", 10_000_000.0),
    "max_market_cap": ("double", None),
    "min_volume": ("double", 250_000.0),
    "weighting": ("string", "equal"),
    "fill_with_btc": ("boolean", True),
    "fee_pct": ("double", 0.1),
    "rotation": ("string", "rebalance"),
    "sell_score": ("double", None),
    "min_trend_30d": ("double", None),
    "stop_loss_pct": ("double", None),
    "trailing_stop_pct": ("double", None),
    "take_profit_pct": ("double", None),
    "regime_filter": ("string", None),
    "regime_min_breadth": ("double", 0.5),
    "regime_exposure": ("double", 0.0),
    "equity_trend_exposure": ("double", None),
    "profit_lock_pct": ("double", None),
    "short_n": ("int", 0),
    "short_max_score": ("double", None),
    "short_funding_apr": ("double", 0.0),
    "short_exposure": ("double", 1.0),
    "profit_sweep_pct": ("double", 0.0),
    "max_holding_periods": ("int", None),
    "invert_score": ("boolean", False),
    "ic_filter": ("boolean", False),
    "ic_window": ("int", 6),
    "ic_threshold": ("double", 0.0),
    "ic_exposure": ("double", 0.35),
    "score_model": ("string", "rule"),
}
SCHEMA = "strategy_id string, " + ", ".join(f"{name} {kind}" for name, (kind, _) in DEFAULTS.items())

# The five named presets, as differences from the defaults.
PRESETS: dict[str, dict[str, object]] = {
    "conservative": {
        "frequency": "quarterly", "top_n": 3, "min_score": 60.0, "rotation": "hold", "sell_score": 10.0,
        "min_trend_30d": 10.0, "trailing_stop_pct": 75.0, "take_profit_pct": 100.0, "regime_exposure": 0.35,
        "short_funding_apr": 10.0, "short_exposure": 0.25,
    },
    "balanced": {
        "top_n": 3, "weighting": "score", "rotation": "hold", "sell_score": 3.0, "min_trend_30d": -25.0,
        "regime_filter": "alt_trend", "regime_exposure": 0.35, "short_n": 3, "short_max_score": 40.0,
        "short_funding_apr": 10.0, "short_exposure": 0.25, "profit_sweep_pct": 50.0,
    },
    "aggressive": {
        "top_n": 2, "weighting": "score", "rotation": "hold", "sell_score": 3.0, "min_trend_30d": -25.0,
        "regime_filter": "alt_trend", "regime_exposure": 0.35, "short_n": 3, "short_max_score": 40.0,
        "short_funding_apr": 10.0, "short_exposure": 0.5, "profit_sweep_pct": 30.0,
    },
    "hedge": {
        "top_n": 5, "min_score": 20.0, "min_market_cap": 500_000_000.0, "max_market_cap": 10_000_000_000.0,
        "weighting": "market_cap", "rotation": "hold", "sell_score": 5.0, "min_trend_30d": -25.0,
        "stop_loss_pct": 30.0, "trailing_stop_pct": 50.0, "regime_filter": "breadth", "regime_min_breadth": 0.5,
        "regime_exposure": 0.25, "equity_trend_exposure": 0.35, "profit_lock_pct": 50.0, "short_n": 5,
        "short_max_score": 40.0, "short_funding_apr": 10.0, "short_exposure": 1.0, "ic_filter": True,
        "ic_window": 12, "ic_threshold": 0.05, "ic_exposure": 0.0,
    },
    "optimized": {
        "top_n": 4, "min_score": 30.0, "min_market_cap": 50_000_000.0, "max_market_cap": 1_000_000_000.0,
        "weighting": "score", "rotation": "hold", "sell_score": 10.0, "min_trend_30d": -60.0, "stop_loss_pct": 30.0,
        "trailing_stop_pct": 75.0, "regime_exposure": 0.25, "equity_trend_exposure": 0.0, "short_n": 2,
        "short_max_score": 40.0, "short_funding_apr": 10.0, "short_exposure": 1.0, "profit_sweep_pct": 70.0,
        "invert_score": True, "ic_filter": True, "ic_window": 4,
    },
}


def strategies(spark: SparkSession, configs: dict[str, dict[str, object]]) -> DataFrame:
    """Strategy rows: given values over the defaults; an unknown parameter is rejected."""
    rows = []
    for key, config in configs.items():
        unknown = sorted(set(config) - set(DEFAULTS))
        if unknown:
            raise ValueError(f"unknown strategy parameter: {', '.join(unknown)}")
        rows.append((key, *[config.get(name, default) for name, (_, default) in DEFAULTS.items()]))
    return spark.createDataFrame(rows, SCHEMA)


def presets(spark: SparkSession) -> DataFrame:
    return strategies(spark, PRESETS)
