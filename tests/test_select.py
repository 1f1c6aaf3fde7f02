"""Exact order statistics by refinement, against sorting."""

import random

import pytest

from tidemark.functions import select
from tidemark.operators.board import robust_domain, summary_strip


@pytest.mark.parametrize("kind", ["spread", "concentrated", "ties", "two"])
def test_order_statistics_equal_sorting(spark, monkeypatch, kind):
    monkeypatch.setattr(select, "FEW", 10)
    rng = random.Random(kind)
    draw = {
        "spread": lambda: rng.choice([rng.gauss(0, 1e-6), rng.gauss(0, 1e9), -0.0, 0.0]),
        "concentrated": lambda: 99 + rng.random() / 1e6,
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 3])),
        "two": lambda: rng.choice([1.0, 1.0000000000000002]),
    }[kind]
    values = [draw() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    places = [0, 1, 7, 1499, 1500, 2998, 2999]
    assert select.order_statistics(df, "x", places) == [sorted(values)[p] for p in places]
    with pytest.raises(IndexError):
        select.order_statistics(df, "x", [3000])


def test_quantiles_between_neighbours_and_empty(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "distance double")
    assert select.quantiles(df, "distance", (0.0, 0.5, 0.9, 1.0)) == [1.0, 3.0, 4 + 4 * (0.9 * 3 - 2), 8.0]
    assert select.quantiles(df.filter("false"), "distance", (0.5,)) == [None]
    assert summary_strip(df).first().median == 3.0
    none = summary_strip(df.filter("false")).first()
    assert (none.tracked, none.median) == (0, None)
    assert robust_domain(df).first().overflow == 0


def test_no_buffer_of_all_values_in_the_plan(spark):
    df = spark.createDataFrame([(float(v),) for v in range(50)], "distance double")
    for out in (summary_strip(df), robust_domain(df)):
        plan = out._jdf.queryExecution().executedPlan().toString().lower()
        assert "percentile(" not in plan and "median(" not in plan
