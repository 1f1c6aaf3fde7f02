"""Learned score: samples, walk-forward fits from Gram blocks, evaluation and export."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.ranks import rank_columns, to_percentile
from tidemark.operators.calendar import Calendar
from tidemark.operators.research import block_bootstrap_ci, proxy_curve, quintile_spread, rank_ic, summary_stats, top_n_forward
from tidemark.operators.score import oriented_ranks
from tidemark.plans.panel import forward_pairs
from tidemark.session import materialize

FEATURES = list(P.FEATURE_DIRECTIONS)
WIDTH = len(FEATURES) + 2
INPUTS = [
    "score", "distance", "valuation_pct_1y", "valuation_pct_3y", "valuation_pct_all", "median_dist_3y", "basing_pct_90d",
    "range_position", "trend_7d", "trend_90d", "trend_180d", "trend_365d", "volatility_90d", "drawdown_from_ath",
    "days_since_ath", "dollar_volume_30d", "band_p05_dist_3y", "band_p25_dist_3y", "band_p75_dist_3y",
    "band_p95_dist_3y", "band_iqr_width_3y", "band_span_width_3y", "above_p75_3y", "below_p25_3y",
    "top_band_share_90d", "dip_bounces", "dip_bounce_avg",
]


def training_samples(
    panel: DataFrame,
    calendar: Calendar,
    regime: DataFrame,
    horizon: int = 1,
    min_universe: int = P.MIN_UNIVERSE,
    regime_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(labels, features): centred forward-return ranks and oriented cross-sectional feature ranks.

    ``labels`` has pos (dense anchor number), idx, anchor, symbol, y, baseline, ret, risk_on;
    ``features`` is long (idx, symbol, name, x).
    """
    pairs = forward_pairs(panel, calendar, horizon, tuple(INPUTS), both=False)
    wide = pairs.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_universe).select("idx")
    flags = regime.select("idx", F.coalesce("alt_above_sma", F.lit(False)).alias("risk_on"))
    kept = wide.join(flags, "idx", "left")
    if regime_only:
        kept = kept.filter("risk_on")
    numbered = kept.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("idx")) - 1)
    rows = materialize(pairs.join(numbered, "idx"), "samples")
    ranked = rank_columns(rows, ["idx"], ["symbol"], ["ret"])
    y = to_percentile(F.col("ret_rank"), F.col("group_n"), 1.0) - 0.5
    labels = rows.select("pos", "idx", "anchor", "symbol", F.col("score").alias("baseline"), "ret", "risk_on").join(
        ranked.select("idx", "symbol", y.alias("y")), ["idx", "symbol"]
    )
    return labels, oriented_ranks(rows, ["idx"])


def sample_vectors(labels: DataFrame, features: DataFrame) -> DataFrame:
    """One row per sample with its 26 features as an array in the fixed order."""
    order = {n: i for i, n in enumerate(FEATURES)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("name"))
    grouped = features.groupBy("idx", "symbol").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("i"), "x")))["x"].alias("v")
    )
    return labels.join(grouped, ["idx", "symbol"])


def gram_blocks(vectors: DataFrame) -> DataFrame:
    """Per anchor position the sums of products of (1, features, label), one row per matrix cell.

    Every Arrow batch is reduced to one small matrix per anchor it contains before the shuffle,
    so the shuffled volume depends on anchors and partitions, not on samples.
    """
    def partial(batches):
        for pdf in batches:
            out = []
            for pos, rows in pdf.groupby("pos"):
                z = np.column_stack([np.ones(len(rows)), np.stack(rows["v"].to_numpy()), rows["y"].to_numpy()])
                out.append((pos, (z.T @ z).ravel().tolist()))
            yield pd.DataFrame(out, columns=["pos", "g"])

    partials = vectors.select("pos", "v", "y").mapInPandas(partial, "pos int, g array<double>")
    cells = partials.select("pos", F.posexplode("g").alias("cell", "g"))
    return cells.groupBy("pos", "cell").agg(F.sum("g").alias("g"))


def fit_folds(blocks: DataFrame, folds: DataFrame, min_anchors: int = 6, iterations: int = 60, l2: float = 0.05) -> DataFrame:
    """Non-negative ridge weights per fold: (fold, name, weight, mean, scale, n).

    An expanding fold is the sum of its anchors' blocks, so Spark reduces each fold to one
    28 x 28 matrix; only that matrix enters the solver.
    """
    members = folds.filter(F.col("train_end") >= min_anchors).select(
        "fold", F.explode(F.sequence("train_start", F.col("train_end") - 1)).alias("pos")
    )
    cells = members.join(blocks, "pos").groupBy("fold", "cell").agg(F.sum("g").alias("g"))
    matrices = cells.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("cell", "g")))["g"].alias("g"))
    width, names = WIDTH, FEATURES

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = pdf["fold"].iloc[0]
        g = np.array(pdf["g"].iloc[0]).reshape(width, width)
        n = g[0, 0]
        mean, ybar = g[0, 1:-1] / n, g[0, -1] / n
        cov = g[1:-1, 1:-1] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0.0) / max(1.0, n - 1))
        scale[scale < 1e-12] = 1.0
        gram = cov / np.outer(scale, scale)
        target = (g[1:-1, -1] - n * mean * ybar) / scale
        w = np.zeros(width - 2)
        for _ in range(iterations):
            for j in range(len(w)):
                pull = target[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = max(0.0, pull / (l2 * n + gram[j, j]))
        return pd.DataFrame({"fold": fold, "name": names, "weight": w, "mean": mean, "scale": scale, "n": int(n)})

    return matrices.groupBy("fold").applyInPandas(
        solve, "fold int, name string, weight double, mean double, scale double, n long"
    )


def standardize(features: DataFrame, labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Mean and sample deviation (1 when 0) of every feature over each fold's training rows."""
    members = folds.select("fold", F.explode(F.sequence("train_start", F.col("train_end") - 1)).alias("pos"))
    rows = features.join(labels.select("idx", "symbol", "pos"), ["idx", "symbol"]).join(members, "pos")
    out = rows.groupBy("fold", "name").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    return out.select("fold", "name", "mean", F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s")).alias("scale"))


def predictions(labels: DataFrame, features: DataFrame, folds: DataFrame, weights: DataFrame) -> DataFrame:
    """Model prediction beside the baseline score on each fold's test anchors."""
    tests = folds.select("fold", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("pos"))
    rows = labels.join(tests, "pos")
    scored = (
        features.join(rows.select("idx", "symbol", "fold"), ["idx", "symbol"])
        .join(weights.select("fold", "name", "weight"), ["fold", "name"])
        .groupBy("fold", "idx", "symbol")
        .agg(F.round(F.sum(F.col("weight") * F.col("x")), 12).alias("model"))
    )
    return rows.join(scored, ["fold", "idx", "symbol"])


def evaluate_model(predicted: DataFrame, periods_per_year: int = 12, weights: DataFrame | None = None, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Report rows (section, metric, value): correlations, spreads and top-3 proxies of model and baseline, the 95 %
    interval of the difference of their correlations, the figures of each fold, and the mean weight of each feature over
    the folds, if `weights` (fold, name, weight) is given."""
    rows = materialize(predicted, "predictions")
    by = ["fold", "idx"]
    ic = {s: rank_ic(rows.withColumn("value", F.col(s)), by).select(*by, F.col("ic").alias(s)) for s in ("model", "baseline")}
    risk = rows.groupBy(*by).agg(F.first("risk_on").alias("risk_on"))
    both = materialize(
        ic["model"].join(ic["baseline"], by).join(risk, by).filter("model is not null and baseline is not null"), "ic-pairs"
    )
    used = rows.join(both.select(*by), by, "left_semi")
    stats = []
    for side in ("model", "baseline"):
        stats.append((f"{side}_ic", summary_stats(both, side)))
        stats.append((f"{side}_ic_risk_on", summary_stats(both.filter("risk_on"), side)))
        spread = quintile_spread(used.withColumn("value", F.col(side)), by)
        stats.append((f"{side}_spread", summary_stats(spread, "spread")))
        top = top_n_forward(used, side, 3, by).withColumn("o", F.col("idx"))
        stats.append((f"{side}_top3", proxy_curve(top, "ret", "o", periods_per_year)))
    stats.append(("ic_delta", summary_stats(both.withColumn("d", F.col("model") - F.col("baseline")), "d")))
    delta = both.select("idx", (F.col("model") - F.col("baseline")).alias("d"))
    stats.append(("ic_delta_ci95", block_bootstrap_ci(delta, "d", "idx", draws=draws, seed=seed)))
    mean = used.groupBy("idx").agg(F.avg("ret").alias("ret"))
    stats.append(("universe_mean", proxy_curve(mean, "ret", "idx", periods_per_year)))
    out = None
    for section, row in stats:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
        part = row.select(F.lit(section).alias("section"), F.explode(cells).alias("p")).select("section", "p.metric", "p.value")
        out = part if out is None else out.unionByName(part)
    folds = both.groupBy("fold").agg(F.avg("model").alias("model_ic"), F.avg("baseline").alias("baseline_ic"), F.count(F.lit(1)).cast("double").alias("n"))
    named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("model_ic", "baseline_ic", "n")])
    out = out.unionByName(folds.select(F.concat(F.lit("fold_"), "fold").alias("section"), F.explode(named).alias("p")).select("section", "p.metric", "p.value"))
    if weights is None:
        return out
    means = weights.groupBy("name").agg(F.avg("weight").alias("value"))
    return out.unionByName(means.select(F.lit("mean_weights").alias("section"), F.col("name").alias("metric"), "value"))


def export_artifact(
    labels: DataFrame, features: DataFrame, until: dt.date, version: str, path: str, min_anchors: int = 12
) -> None:
    """Train on all anchors up to a cutoff and store weights, scaling, directions and provenance as JSON."""
    train = materialize(labels.filter(F.col("anchor") <= F.lit(until)), "train")
    anchors = train.select(F.countDistinct("pos").alias("n"), F.max("pos").alias("last")).first()
    if anchors["n"] < min_anchors:
        raise ValueError(f"only {anchors['n']} training anchors; refusing to export a model")
    spark = labels.sparkSession
    fold = spark.range(1).select(
        F.lit(0).alias("fold"), F.lit(0).alias("train_start"), F.lit(int(anchors["last"]) + 1).alias("train_end")
    )
    fitted = fit_folds(gram_blocks(sample_vectors(train, features)), fold)
    directions = F.create_map(*[F.lit(x) for kv in P.FEATURE_DIRECTIONS.items() for x in kv])
    artifact = fitted.agg(
        F.map_from_entries(F.collect_list(F.struct("name", "weight"))).alias("weights"),
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("mean", "scale")))).alias("feature_scaling"),
        F.max("n").alias("samples"),
    ).select(
        F.lit(version).alias("version"),
        F.lit(str(until)).alias("trained_until"),
        F.struct(F.lit(anchors["n"]).alias("anchors"), "samples").alias("training"),
        "weights",
        "feature_scaling",
        directions.alias("feature_directions"),
    )
    artifact.coalesce(1).write.mode("overwrite").json(path)


#: Direction of each part of the rule, and the names of the two kinds of model in the list of models.
RULE_SIGNS = {"valuation": -1, "distance": -1, "median_gap": -1, "basing": 1, "range": -1, "dip_respect": 1}
MODEL_LABELS = {
    "rule": ("Rule score", "fixed weights on six parts of cheapness"),
    "learned": ("Learned score", "non-negative weights on ranked features, fitted on past anchors"),
}


def model_catalog(weights: DataFrame, version: str) -> DataFrame:
    """Features of the available models with label and description: the rule's six parts and one learned artifact."""
    spark = weights.sparkSession
    named = lambda kind: [F.lit(text).alias(column) for column, text in zip(("label", "description"), MODEL_LABELS[kind])]
    rule = spark.createDataFrame(
        [("rule", k, v, RULE_SIGNS[k]) for k, v in P.SCORE_WEIGHTS.items()], "version string, name string, weight double, direction int"
    )
    learned = weights.select(F.lit(version).alias("version"), *named("learned"), "name", "weight", F.col("direction").cast("int"))
    return rule.select("version", *named("rule"), "name", "weight", "direction").unionByName(learned)
