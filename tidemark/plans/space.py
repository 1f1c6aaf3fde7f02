"""Searchable strategy parameters and gate levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Integer ranges (low, high, step) and categorical choices of the search.
INT_RANGES = {"top_n": (2, 10, 1), "min_score": (0, 80, 5)}
CHOICES = {
    "sell_score": [None, 3, 5, 10, 20, 25, 40],
    "min_market_cap": [0, 10_000_000, 50_000_000, 100_000_000, 500_000_000],
    "max_market_cap": [None, 100_000_000, 500_000_000, 1_000_000_000, 10_000_000_000],
    "equity_trend_exposure": [None, 0.0, 0.35, 0.5, 0.7],
    "profit_lock_pct": [None, 25, 50],
    "short_n": [0, 2, 3, 5],
    "short_max_score": [None, 30, 40, 50],
    "short_funding_apr": [0, 10, 20],
    "short_exposure": [0.0, 0.25, 0.5, 1.0],
    "profit_sweep_pct": [0, 30, 50, 70],
    "ic_filter": [False, True],
    "ic_exposure": [0.0, 0.35, 0.7],
    "ic_window": [2, 4, 6, 12],
    "ic_threshold": [0.0, 0.05, 0.1],
    "invert_score": [False, True],
    "max_holding_periods": [None, 26, 52, 104],
    "min_trend_30d": [None, -60, -40, -25, 0],
    "weighting": ["equal", "score", "market_cap"],
    "rotation": ["hold", "rebalance"],
    "regime_filter": [None, "alt_trend", "breadth"],
    "regime_exposure": [0.0, 0.25, 0.35, 0.5, 0.75, 1.0],
    "trailing_stop_pct": [None, 35, 50, 75],
    "take_profit_pct": [None, 100, 200, 500],
    "stop_loss_pct": [None, 30, 40, 50],
}
DEFAULT_SEARCH = [
    "top_n", "min_score", "sell_score", "min_trend_30d", "weighting", "rotation", "regime_filter", "regime_exposure",
]
STRICTNESS = {"strict": (True, 0.5), "balanced": (False, 0.25), "loose": (False, 0.0)}


def choices(name: str) -> list:
    if name in INT_RANGES:
        low, high, step = INT_RANGES[name]
        return list(range(low, high + 1, step))
    return CHOICES[name]


def param_space(spark: SparkSession) -> DataFrame:
    """(name, position, value) rows; values as text, null where a parameter may be off."""
    rows = [
        (name, i, None if v is None else str(v)) for name in [*INT_RANGES, *CHOICES] for i, v in enumerate(choices(name))
    ]
    return spark.createDataFrame(rows, "name string, position int, value string")


def scope_violations(space: DataFrame, searched: DataFrame, pinned: DataFrame) -> DataFrame:
    """Problems of a search scope: unknown, missing, both searched and pinned, or an illegal pinned value.

    ``searched`` has name; ``pinned`` has name and value.
    """
    names = space.select("name").distinct()
    used = searched.select("name").unionByName(pinned.select("name"))
    unknown = used.join(names, "name", "left_anti").select("name", F.lit("unknown").alias("problem"))
    missing = names.join(used, "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    both = searched.select("name").join(pinned.select("name"), "name").select("name", F.lit("both").alias("problem"))
    known = pinned.join(names, "name", "left_semi").alias("p")
    legal = space.alias("s")
    match = (F.col("p.name") == F.col("s.name")) & F.col("p.value").eqNullSafe(F.col("s.value"))
    illegal = known.join(legal, match, "left_anti").select("name", F.lit("illegal value").alias("problem"))
    return unknown.unionByName(missing).unionByName(both).unionByName(illegal).distinct()


def _halves(names: list[str]) -> tuple[list[str], list[str]]:
    """The searched parameters in two parts of about equally many configurations."""
    first, rest = [], list(names)
    while rest and math.prod(len(choices(n)) for n in first) < math.prod(len(choices(n)) for n in rest):
        first.append(rest.pop(0))
    return first, rest


def _draw(seed: int, turn: int, value: Column, size: int) -> Column:
    """Keyed number below `size`: the first 32 bits of an MD5, which any engine has."""
    text = F.concat(F.lit(f"{seed}:{turn}:"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size))


TURNS = 4


def sample_strategies(spark: SparkSession, names: list[str], trials: int, seed: int, frequency: str, pinned: dict | None = None) -> DataFrame:
    """Exactly `trials` different random configurations of the searched parameters.

    A configuration is a number in mixed radix, one digit per parameter, and trial t takes the number that a keyed
    permutation of all numbers puts at t: a Feistel network on the two halves of the digits. So trials differ by
    construction, whatever the number of partitions, and asking for more than there are is an error.
    """
    from tidemark.plans.presets import DEFAULTS

    first, rest = _halves(names)
    a, b = (math.prod(len(choices(n)) for n in part) for part in (first, rest))
    if trials > a * b:
        raise ValueError(f"{trials} trials asked of {a * b} configurations")
    x, y = F.col("id") % a, F.floor(F.col("id") / a)
    rows = spark.range(trials).select(F.col("id").alias("trial"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    for turn in range(TURNS):
        rows = rows.withColumn("x", (F.col("x") + _draw(seed, 2 * turn, F.col("y"), a)) % a)
        rows = rows.withColumn("y", (F.col("y") + _draw(seed, 2 * turn + 1, F.col("x"), b)) % b)
    digits: dict[str, Column] = {}
    for part, column in ((first, "x"), (rest, "y")):
        number = F.col(column)
        for name in part:
            digits[name] = (number % len(choices(name))).cast("int")
            number = F.floor(number / len(choices(name)))
    columns = []
    for name, (kind, default) in DEFAULTS.items():
        if name in digits:
            column = F.get(F.array(*[F.lit(v).cast(kind) for v in choices(name)]), digits[name])
        else:
            column = F.lit(frequency if name == "frequency" else (pinned or {}).get(name, default)).cast(kind)
        columns.append(column.alias(name))
    return rows.select(F.format_string("trial-%06d", "trial").alias("strategy_id"), *columns)
