"""Factor research over the panel: rank correlation, spreads, bootstrap, folds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.ranks import count_before, fits, rank_columns
from tidemark.operators.calendar import Calendar
from tidemark.plans.panel import forward_returns
from tidemark.session import materialize

SIGNAL_COLUMNS = ("score", "distance", "trend_30d", "above_sma200")


def signals() -> dict[str, Column]:
    """Signals under study, missing values as zero."""
    zero = F.lit(0.0)
    return {
        "score": F.col("score"),
        "distance_neg": -F.coalesce("distance", zero),
        "trend30": F.coalesce("trend_30d", zero),
        "sma200": F.coalesce(F.col("above_sma200").cast("double"), zero),
    }


def signal_library(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep, name, value): one row per panel row and signal."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), (c + F.lit(0.0)).alias("value")) for n, c in signals().items()])
    return rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.name", "p.value")


def with_forward(
    panel: DataFrame, calendar: Calendar, step: int = 1, min_universe: int = P.MIN_UNIVERSE
) -> DataFrame:
    """(idx, anchor, symbol, name, value, ret): every signal beside its forward return."""
    pairs = forward_returns(panel, calendar, step, min_universe, SIGNAL_COLUMNS)
    return signal_library(pairs, ("idx", "anchor", "symbol", "ret"))


def rank_ic(rows: DataFrame, by: Sequence[str], x: str = "value", y: str = "ret", whole: bool | None = None) -> DataFrame:
    """Spearman correlation per group: Pearson of average ranks.

    Null for fewer than three rows or a constant side.
    """
    by = list(by)
    ranked = rank_columns(rows, by, ["symbol"], [x, y], whole=whole)
    rx, ry = F.col(f"{x}_rank"), F.col(f"{y}_rank")
    stats = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop(rx, ry).alias("cov"),
        F.var_pop(rx).alias("vx"),
        F.var_pop(ry).alias("vy"),
    )
    valid = (F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0)
    return stats.select(*by, "n", F.when(valid, F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))).alias("ic"))


def quintile_spread(rows: DataFrame, by: Sequence[str], x: str = "value", y: str = "ret", whole: bool | None = None) -> DataFrame:
    """Mean return of the top fifth minus the bottom fifth, ordered by (signal, return).

    Where a group is one task, rows are numbered by a window. Beyond, distinct (signal, return) pairs are counted: the
    position of a pair is the number of rows with a smaller signal plus, inside one signal value, the
    number with a smaller return.
    """
    by = list(by)
    if fits(rows, by) if whole is None else whole:
        w = Window.partitionBy(*by)
        numbered = rows.select(*by, y, F.row_number().over(w.orderBy(x, y)).alias("__i"), F.count(F.lit(1)).over(w).alias("__n"))
        fifth = F.greatest(F.lit(1), F.floor(F.col("__n") / 5))
        top, bottom = F.when(F.col("__i") > F.col("__n") - fifth, F.col(y)), F.when(F.col("__i") <= fifth, F.col(y))
        return numbered.groupBy(*by).agg((F.avg(top) - F.avg(bottom)).alias("spread"), F.first("__n").alias("n"))
    pairs = materialize(rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("n")), "pairs")
    values = pairs.groupBy(*by, x).agg(F.sum("n").alias("n"))
    outer = count_before(values, by, x, whole=False).select(*by, x, F.col("before").alias("__lo"), F.col("total").alias("__n"))
    inner = count_before(pairs, [*by, x], y, whole=False).drop("total")
    placed = inner.join(outer, [*by, x]).withColumn("start", F.col("before") + F.col("__lo"))
    k = F.greatest(F.lit(1), F.floor(F.col("__n") / 5))
    n, start = F.col("n"), F.col("start")
    low = F.greatest(F.lit(0), F.least(n, k - start))
    high = F.greatest(F.lit(0), F.least(n, start + n - (F.col("__n") - k)))
    return placed.groupBy(*by).agg(
        (F.sum(high * F.col(y)) / F.first(k) - F.sum(low * F.col(y)) / F.first(k)).alias("spread"), F.first("__n").alias("n")
    )


def summary_stats(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, t statistic, positive share and count; zeros when empty."""
    v = F.col(value)
    agg = values.filter(v.isNotNull()).groupBy(*by).agg(
        F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.avg((v > 0).cast("double")).alias("p"), F.count(v).alias("n")
    )
    std = F.coalesce("s", F.lit(0.0))
    return agg.select(
        *by,
        F.coalesce("m", F.lit(0.0)).alias("mean"),
        std.alias("std"),
        F.when(std > 0, F.col("m") / std * F.sqrt("n")).otherwise(0.0).alias("t"),
        F.coalesce("p", F.lit(0.0)).alias("positive_share"),
        "n",
    )


def per_year(ic: DataFrame, spread: DataFrame) -> DataFrame:
    a = ic.groupBy(F.year("anchor").alias("year")).agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n"))
    b = spread.groupBy(F.year("anchor").alias("year")).agg(F.avg("spread").alias("spread_mean"))
    return a.join(b, "year", "full")


def ic_by_horizon(panel: DataFrame, calendar: Calendar, steps: Sequence[int], min_universe: int) -> DataFrame:
    """Rank correlation of the score at several forward steps, one pass over all of them."""
    parts = [
        forward_returns(panel, calendar, k, min_universe, ("score",)).select(
            F.lit(k).alias("step"), "idx", "symbol", F.col("score").alias("value"), "ret"
        )
        for k in steps
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return summary_stats(rank_ic(rows, ["step", "idx"]), "ic", ["step"])


def block_bootstrap_ci(
    values: DataFrame, value: str, order: str, block: int = 3, draws: int = 2000, seed: int = 7
) -> DataFrame:
    """95 % interval of the mean by a circular moving-block bootstrap.

    ``values`` is calendar-sized (one row per anchor). Every draw is a set of (draw, position)
    rows joined to the series by position; block starts are hashes of (seed, draw, block number),
    so a run repeats exactly whatever the partitioning.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    series = values.filter(F.col(value).isNotNull()).select(
        (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("v")
    )
    n = series.agg(F.count(F.lit(1))).select("count(1)").scalar()
    spark = values.sparkSession
    per_draw = spark.range(draws).select(F.col("id").alias("draw"), n.alias("n")).filter(F.col("n") > 0)
    slots = per_draw.select("draw", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    start = F.pmod(F.xxhash64(F.lit(seed), "draw", F.floor(F.col("slot") / block)), F.col("n"))
    picks = slots.select("draw", F.pmod(start + F.col("slot") % block, F.col("n")).alias("i"))
    means = picks.join(series, "i").groupBy("draw").agg(F.avg("v").alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("s"))
    at = lambda q: F.element_at("s", int(q * draws) + 1)
    return ordered.select(
        F.when(F.size("s") > 0, at(0.025)).otherwise(0.0).alias("lo"),
        F.when(F.size("s") > 0, at(0.975)).otherwise(0.0).alias("hi"),
    )


def baseline_report(panel: DataFrame, calendar: Calendar, min_universe: int, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Summary of every signal's rank correlation and of the score's quintile spread."""
    rows = materialize(with_forward(panel, calendar, 1, min_universe), "forward")
    ic = rank_ic(rows, ["name", "idx"])
    spread = quintile_spread(rows.filter("name = 'score'"), ["idx"])
    out = summary_stats(ic, "ic", ["name"]).withColumn("section", F.lit("ic"))
    tail = summary_stats(spread.withColumn("name", F.lit("score")), "spread", ["name"]).withColumn("section", F.lit("spread"))
    both = out.unionByName(tail)
    parts = [ic.filter(F.col("name") == n).select(F.lit("ic").alias("section"), F.lit(n).alias("name"), "idx", F.col("ic").alias("v")) for n in signals()]
    parts.append(spread.select(F.lit("spread").alias("section"), F.lit("score").alias("name"), "idx", F.col("spread").alias("v")))
    bounds = None
    for part, (section, name) in zip(parts, [*[("ic", n) for n in signals()], ("spread", "score")]):
        ci = block_bootstrap_ci(part, "v", "idx", 3, draws, seed).withColumns(
            {"section": F.lit(section), "name": F.lit(name)}
        )
        bounds = ci if bounds is None else bounds.unionByName(ci)
    return both.join(bounds, ["section", "name"])


def walk_forward_folds(
    anchors: DataFrame, horizon: int = 1, test_size: int = 12, min_train: int = 24, embargo: int = 1
) -> DataFrame:
    """Expanding folds over numbered samples: [0, train_end) trains, [test_start, test_end) tests.

    ``anchors`` is any table with one row per sample.
    """
    if horizon < 0 or test_size <= 0 or min_train <= 0 or embargo < 0:
        raise ValueError("horizon and embargo must be >= 0, test_size and min_train > 0")
    first = min_train + horizon + embargo
    n = anchors.agg(F.count(F.lit(1)).cast("int").alias("n"))
    starts = n.filter(F.col("n") > first).select("n", F.posexplode(F.sequence(F.lit(first), F.col("n") - 1, F.lit(test_size))))
    return starts.select(
        F.col("pos").alias("fold"),
        F.lit(0).alias("train_start"),
        (F.col("col") - horizon - embargo).alias("train_end"),
        F.col("col").alias("test_start"),
        F.least(F.col("n"), F.col("col") + test_size).alias("test_end"),
        F.lit(horizon).alias("horizon"),
        F.lit(embargo).alias("embargo"),
    )


def fold_violations(folds: DataFrame, horizon: int) -> DataFrame:
    """Folds that leak: empty test, label reaching the test block, or too small an embargo."""
    last = F.col("train_end") - 1 + horizon
    gap = F.col("test_start") - last
    reason = (
        F.when(F.col("test_start") >= F.col("test_end"), "empty test block")
        .when((F.col("train_end") > 0) & (last >= F.col("test_start")), "label overlap")
        .when((F.col("train_end") > 0) & (gap < F.col("embargo")), "embargo too small")
    )
    return folds.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def proxy_curve(returns: DataFrame, value: str, order: str, periods_per_year: int = 12) -> DataFrame:
    """Total return, Sharpe ratio and drawdown of a period-return series (one row per period)."""
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.select(order, F.col(value).alias("r"), F.product(1.0 + F.col(value)).over(w).alias("equity"))
    dd = curve.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return dd.agg(
        (F.coalesce(F.max_by("equity", order), F.lit(1.0)) - 1.0).alias("total_return"),
        F.when(F.stddev_samp("r") > 0, F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(float(periods_per_year))))
        .otherwise(0.0)
        .alias("sharpe"),
        F.least(F.lit(0.0), F.min(F.col("equity") / F.col("peak") - 1.0)).alias("max_drawdown"),
        F.count(F.lit(1)).alias("periods"),
    )


def top_n_forward(rows: DataFrame, score: str, n: int = 3, by: Sequence[str] = ("idx",)) -> DataFrame:
    """Mean forward return of the n best rows per group (rank limit cut on the map side)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "symbol"))
    return rows.withColumn("__p", place).filter(F.col("__p") <= n).groupBy(*by).agg(F.avg("ret").alias("ret"))


def leakage(old: DataFrame, new: DataFrame, until: dt.date) -> DataFrame:
    """Panel rows at old anchors that differ once later candles have arrived; expect none."""
    cols = [c for c in old.columns if c not in ("anchor", "symbol")]
    a = old.filter(F.col("anchor") <= F.lit(until)).select("anchor", "symbol", F.struct(*cols).alias("before"))
    b = new.filter(F.col("anchor") <= F.lit(until)).select("anchor", "symbol", F.struct(*cols).alias("after"))
    return a.join(b, ["anchor", "symbol"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))
