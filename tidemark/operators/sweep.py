"""Walk-forward validation of many strategies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators.strategy import consistency_metrics
from tidemark.plans.space import STRICTNESS

HORIZON = 1
EMBARGO = 1


def split_anchors(anchors: DataFrame, fraction: float) -> DataFrame:
    """(anchor, idx, n, n_train, is_holdout): the trailing fraction (0.1 to 0.5) is held out."""
    fraction = min(0.5, max(0.1, fraction))
    n = anchors.agg(F.count(F.lit(1)).cast("int").alias("n"))
    holdout = F.greatest(F.lit(2), F.rint(F.col("n") * fraction).cast("int"))
    sized = n.withColumn("n_train", F.col("n") - holdout).filter(F.col("n_train") >= 6)
    size = sized.select("n_train").scalar()
    return anchors.select("anchor", "idx").withColumn("n_train", size).filter(F.col("n_train").isNotNull()).withColumn(
        "is_holdout", F.col("idx") >= F.col("n_train")
    )


def cv_folds(split: DataFrame, folds: int = 3) -> DataFrame:
    """Contiguous test blocks in the tail of the training anchors, after purge and embargo."""
    wanted = max(1, min(6, int(folds)))
    n = split.agg(F.max("n_train").alias("n"))
    start = F.greatest(F.lit(3), F.floor(F.col("n") / 3)) + HORIZON + 1
    plan = (
        n.withColumn("tail", start.cast("int"))
        .withColumn("available", F.col("n") - F.col("tail"))
        .filter(F.col("available") >= 2)
        .withColumn("k", F.greatest(F.lit(1), F.least(F.lit(wanted), F.floor(F.col("available") / 2))).cast("int"))
        .withColumn("size", F.floor(F.col("available") / F.col("k")).cast("int"))
    )
    rows = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("fold"))
    first = F.col("tail") + F.col("fold") * F.col("size")
    return rows.select(
        "fold",
        F.lit(0).alias("train_start"),
        (first - HORIZON - 1).alias("train_end"),
        first.alias("test_start"),
        F.when(F.col("fold") == F.col("k") - 1, F.col("n")).otherwise(first + F.col("size")).alias("test_end"),
        F.lit(EMBARGO).alias("embargo"),
    )


def slices(split: DataFrame, folds: DataFrame) -> DataFrame:
    """(slice, first_idx, last_idx): the training region, the holdout and every fold's test block."""
    sizes = split.agg(F.max("n_train").alias("n_train"), F.max("idx").alias("last"))
    train = sizes.select(F.lit("train").alias("slice"), F.lit(0).alias("first_idx"), (F.col("n_train") - 1).alias("last_idx"))
    hold = sizes.select(F.lit("holdout").alias("slice"), F.col("n_train").alias("first_idx"), F.col("last").alias("last_idx"))
    tests = folds.select(
        F.concat(F.lit("fold"), "fold").alias("slice"), F.col("test_start").alias("first_idx"), (F.col("test_end") - 1).alias("last_idx")
    )
    return train.unionByName(hold).unionByName(tests)


def slice_metrics(curve: DataFrame, slice_rows: DataFrame, frequency: str) -> DataFrame:
    """Metrics of date slices of a continuous curve, positions carried across the edges.

    The point at a slice's first anchor is its base. The slices are expanded to anchor indices
    first (calendar-sized), so the curve meets them in an equality join.
    """
    per_year = 365.0 / P.FREQUENCY_DAYS[frequency]
    keys = ["strategy_id", "slice"]
    marks = slice_rows.select("slice", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    rows = curve.select("strategy_id", "idx", "anchor", "equity", "period_return").join(marks, "idx")
    w = Window.partitionBy(*keys).orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k": F.row_number().over(w) - 1, "peak": F.max("equity").over(whole)})
    r = F.when(F.col("k") > 0, F.col("period_return"))
    body = rows.groupBy(*keys).agg(
        F.min_by("equity", "idx").alias("e0"),
        F.max_by("equity", "idx").alias("e1"),
        F.avg(r).alias("m"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("s"),
        F.avg(F.when(F.col("k") > 0, (F.col("period_return") > 0).cast("double"))).alias("win_rate"),
        F.least(F.lit(0.0), F.min(F.col("equity") / F.col("peak") - 1.0)).alias("max_drawdown"),
        F.datediff(F.max("anchor"), F.min("anchor")).alias("days"),
        (F.count(F.lit(1)) - 1).alias("periods"),
    ).filter(F.col("periods") > 0)
    growth = F.when(F.col("e0") != 0, F.col("e1") / F.col("e0")).otherwise(0.0)
    years = F.greatest(F.col("days") / 365.0, F.lit(1 / 365.0))
    out = body.withColumn("cagr", F.when(growth > 0, F.pow(growth, 1.0 / years) - 1.0).otherwise(-1.0)).select(
        *keys,
        F.when(F.col("e0") != 0, F.col("e1") / F.col("e0") - 1.0).otherwise(0.0).alias("total_return"),
        "cagr",
        (F.col("s") * per_year**0.5).alias("volatility"),
        F.when(F.col("s") > 0, F.col("m") / F.col("s") * per_year**0.5).otherwise(0.0).alias("sharpe"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "win_rate",
        "periods",
    )
    return out.join(consistency_metrics(rows, keys, frequency, sliced=True), keys)


def objective(metrics: DataFrame, name: str) -> DataFrame:
    """Objective value of metric rows, rounded like the metrics are."""
    values = {
        "return": F.round("total_return", 4),
        "sharpe": F.round("sharpe", 3),
        "calmar": F.coalesce(F.round("calmar", 3), F.lit(-10.0)),
        "consistency": F.round("positive_rolling_share", 4),
    }
    if name not in values:
        raise ValueError(f"objective must be one of {', '.join(values)}")
    return metrics.withColumn("objective", values[name])


def cv_score(scored: DataFrame, max_drawdown_pct: float | None = None) -> DataFrame:
    """Mean and minimum objective over the folds; strategies that break the limit in any fold drop out."""
    folds = scored.filter(F.col("slice").startswith("fold"))
    rows = folds.groupBy("strategy_id").agg(
        F.round(F.avg("objective"), 4).alias("cv_mean"),
        F.round(F.min("objective"), 4).alias("cv_min"),
        F.min("max_drawdown").alias("worst"),
    )
    if max_drawdown_pct is not None:
        rows = rows.filter(F.round("worst", 4) >= -abs(max_drawdown_pct) / 100.0)
    return rows.drop("worst")


def holdout_gate(cv: DataFrame, scored: DataFrame, strictness: str) -> DataFrame:
    """Verdict per strategy: passed, or the first reason against it."""
    need_min, gap = STRICTNESS[strictness]
    hold = scored.filter("slice = 'holdout'").select(
        "strategy_id", F.round("total_return", 4).alias("holdout_return"), F.col("objective").alias("holdout_score")
    )
    rows = cv.join(hold, "strategy_id", "left")
    reason = (  # fixed values: the reasons' texts
        F.when(F.col("holdout_score").isNull() | F.col("cv_mean").isNull(), "missing validation data")
        .when(F.col("cv_mean") <= 0, "CV mean not positive")
        .when(F.lit(need_min) & (F.col("cv_min") <= 0), "a walk-forward fold lost")
        .when(F.col("holdout_return") <= 0, "holdout loses money")
        .when(F.col("holdout_score") <= 0, "holdout not positive")
        .when(F.col("holdout_score") < gap * F.col("cv_mean"), "holdout keeps less than the required share of the CV edge")
    )
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def sweep_report(verdicts: DataFrame, top_k: int = 5) -> DataFrame:
    """Best distinct strategies of all verdicts: those that pass first, then by CV mean and minimum.

    Strategies with equal CV figures and holdout return are one, the smallest id of them.
    """
    same = ["cv_mean", "cv_min", F.round("holdout_return", 3).alias("sig")]
    distinct = verdicts.groupBy(*same).agg(F.min_by(F.struct(*verdicts.columns), "strategy_id").alias("v")).select("v.*")
    return distinct.orderBy(F.desc("passed"), F.desc("cv_mean"), F.desc("cv_min"), "strategy_id").limit(top_k)


def rejection_reasons(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(~F.col("passed")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def provenance(split: DataFrame, folds: DataFrame) -> DataFrame:
    """Date ranges of the training region, the holdout and the folds."""
    days = split.select("idx", "anchor")
    ranges = slices(split, folds).unionByName(
        folds.select(
            F.concat(F.lit("train"), "fold").alias("slice"), F.col("train_start").alias("first_idx"), (F.col("train_end") - 1).alias("last_idx")
        )
    )
    first = days.select(F.col("idx").alias("first_idx"), F.col("anchor").alias("first_anchor"))
    last = days.select(F.col("idx").alias("last_idx"), F.col("anchor").alias("last_anchor"))
    return ranges.join(first, "first_idx").join(last, "last_idx").select(
        "slice", "first_anchor", "last_anchor", (F.col("last_idx") - F.col("first_idx") + 1).alias("anchors")
    )
