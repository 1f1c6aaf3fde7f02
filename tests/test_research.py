import numpy as np
import pytest

from tidemark.operators import learned as K
from tidemark.operators import sweep as L
from tidemark.operators.research import block_bootstrap_ci, fold_violations, summary_stats, walk_forward_folds
from tidemark.plans.space import DEFAULT_SEARCH, param_space, sample_strategies, scope_violations


def test_walk_forward_folds(spark):
    rows = walk_forward_folds(spark.range(100)).orderBy("fold").collect()
    assert len(rows) == 7
    assert (rows[0]["train_end"], rows[0]["test_start"], rows[0]["test_end"]) == (24, 26, 38)
    assert (rows[-1]["test_start"], rows[-1]["test_end"]) == (98, 100)
    assert fold_violations(walk_forward_folds(spark.range(100)), 1).count() == 0
    assert fold_violations(walk_forward_folds(spark.range(100)), 5).count() == 7


def test_bootstrap_is_deterministic_and_covers_the_mean(spark):
    rng = np.random.default_rng(1)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(0.1, 1, 80))], "i int, v double")
    a = block_bootstrap_ci(values, "v", "i", draws=400).first()
    b = block_bootstrap_ci(values.repartition(7), "v", "i", draws=400).first()
    mean = summary_stats(values, "v").first()["mean"]
    assert tuple(a) == tuple(b) and a["lo"] < mean < a["hi"]
    width = a["hi"] - a["lo"]
    assert 0.2 < width < 0.8


def test_gram_fit_equals_the_direct_loop(spark):
    rng = np.random.default_rng(2)
    n, width = 400, len(K.FEATURES)
    x = rng.random((n, width))
    true = np.zeros(width)
    true[[0, 3, 7]] = [0.5, 0.3, 0.2]
    y = x @ true + rng.normal(0, 0.05, n)
    rows = [(int(i % 20), str(i), x[i].tolist(), float(y[i])) for i in range(n)]
    vectors = spark.createDataFrame(rows, "pos int, symbol string, v array<double>, y double")
    fold = spark.createDataFrame([(0, 0, 20)], "fold int, train_start int, train_end int")
    got = {r["name"]: r["weight"] for r in K.fit_folds(K.gram_blocks(vectors), fold).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    c = y - y.mean()
    w, pred = np.zeros(width), np.zeros(n)
    for _ in range(60):
        for j in range(width):
            new = max(0.0, z[:, j] @ (c - pred + w[j] * z[:, j]) / (0.05 * n + z[:, j] @ z[:, j]))
            pred += (new - w[j]) * z[:, j]
            w[j] = new
    assert np.allclose([got[f] for f in K.FEATURES], w, atol=1e-9)
    assert np.argmax(w) == 0


def test_split_and_folds_keep_the_gap(spark):
    anchors = spark.range(60).selectExpr("date_add(date'2020-01-01', cast(id * 7 as int)) as anchor", "cast(id as int) as idx")
    split = L.split_anchors(anchors, 0.3)
    assert split.filter("is_holdout").count() == 18
    for wanted in (1, 3, 9):
        folds = L.cv_folds(split, wanted).orderBy("fold").collect()
        assert len(folds) == min(6, wanted)
        assert folds[0]["test_start"] == 16 and folds[-1]["test_end"] == 42
        assert all(f["test_start"] - f["train_end"] == 2 for f in folds)


def test_gate_levels(spark):
    cv = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, -0.1), ("c", -1.0, -2.0), ("d", 1.0, 0.5), ("e", 1.0, 0.5)], "strategy_id string, cv_mean double, cv_min double")
    scored = spark.createDataFrame(
        [("a", "holdout", 0.2, 0.8), ("b", "holdout", 0.2, 0.8), ("c", "holdout", 0.2, 0.8), ("d", "holdout", 0.2, 0.3)],
        "strategy_id string, slice string, total_return double, objective double",
    )
    verdict = lambda level: {r["strategy_id"]: r["reason"] for r in L.holdout_gate(cv, scored, level).collect()}
    strict = verdict("strict")
    assert strict["a"] is None and strict["b"] == "a walk-forward fold lost" and strict["c"] == "CV mean not positive"
    assert strict["d"].startswith("holdout keeps less") and strict["e"] == "missing validation data"
    assert verdict("balanced")["b"] is None and verdict("balanced")["d"] is None


def test_search_scope_and_sampling(spark):
    space = param_space(spark)
    assert space.select("name").distinct().count() == 26
    rest = [r["name"] for r in space.select("name").distinct().collect() if r["name"] not in DEFAULT_SEARCH]
    pinned = space.filter("position = 0").filter(space.name.isin(rest)).select("name", "value")
    searched = spark.createDataFrame([(n,) for n in DEFAULT_SEARCH], "name string")
    assert scope_violations(space, searched, pinned).count() == 0
    bad = spark.createDataFrame([("top_n", "3"), ("leverage", "2"), ("short_n", "99")], "name string, value string")
    problems = {(r["name"], r["problem"]) for r in scope_violations(space, searched, bad).collect()}
    assert {("top_n", "both"), ("leverage", "unknown"), ("short_n", "illegal value"), ("ic_filter", "missing")} <= problems
    a = sample_strategies(spark, DEFAULT_SEARCH, 50, 7, "weekly").orderBy("strategy_id").collect()
    assert a == sample_strategies(spark, DEFAULT_SEARCH, 50, 7, "weekly").orderBy("strategy_id").collect()
    assert len({tuple(r)[:-1] for r in a}) == len(a) > 40


def test_export_needs_enough_anchors(spark):
    labels = spark.createDataFrame([(0, None)], "pos int, anchor date")
    import datetime as dt

    with pytest.raises(ValueError):
        K.export_artifact(labels, labels, dt.date(2020, 1, 1), "v", "/tmp/none")
