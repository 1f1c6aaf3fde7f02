"""Cross-sectional scores: the rule score with its liquidity gates and the learned score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.numeric import clamp, round1
from tidemark.functions.ranks import average_rank, count_before, fits, rank_columns, to_percentile
from tidemark.session import materialize

COMPONENTS = list(P.SCORE_WEIGHTS)


def components() -> dict[str, Column]:
    """Raw cheapness components; larger is cheaper."""
    p3y = F.col("valuation_pct_3y")
    p1y, pall = F.coalesce("valuation_pct_1y", p3y), F.coalesce("valuation_pct_all", p3y)
    zero = F.lit(0.0)
    return {
        "valuation": -(0.5 * p1y + 0.3 * p3y + 0.2 * pall),
        "distance": -F.coalesce("distance", zero),
        "median_gap": -F.abs(F.coalesce("median_dist_3y", zero)),
        "basing": F.coalesce("basing_pct_90d", zero),
        "range": -F.coalesce("range_position", zero),
        "dip_respect": F.coalesce("dip_bounces", F.lit(0)) + F.coalesce("dip_bounce_avg", zero) / 50.0,
    }


def with_components(rows: DataFrame) -> DataFrame:
    # 0.0 - x and -x differ for x = 0; ranks compare values, so fold the signed zero away.
    return rows.withColumns({f"c_{k}": v + F.lit(0.0) for k, v in components().items()})


def knife_penalty() -> Column:
    falling = (F.col("trend_30d") < P.KNIFE_TREND_30D) | (F.col("trend_90d") < P.KNIFE_TREND_90D)
    return F.when(falling, P.KNIFE_PENALTY).otherwise(0.0)


def scorable() -> Column:
    """Everything but the liquidity gates."""
    stable = F.coalesce(F.col("is_stable"), F.lit(False))
    return ~stable & F.col("valuation_pct_3y").isNotNull() & F.col("distance").isNotNull()


def liquid(min_cap: float, min_volume: float) -> Column:
    return (F.coalesce("cap", F.lit(0.0)) >= min_cap) & (F.coalesce("volume", F.lit(0.0)) >= min_volume)


def eligible(rows: DataFrame, min_cap: float = P.SCORE_MIN_CAP, min_volume: float = P.SCORE_MIN_VOLUME) -> DataFrame:
    return rows.filter(scorable() & liquid(min_cap, min_volume))


def _score(pool: DataFrame, by: Sequence[str], whole: bool) -> DataFrame:
    """Score and parts of rows that already carry the component columns and ``knife``. Where a cross-section is one
    task (`whole`), both rankings and what lies between them take one shuffle."""
    names = [f"c_{c}" for c in COMPONENTS]
    ranked = rank_columns(pool, by, ["symbol"], names, keep=["knife"], whole=whole)
    parts = {c: to_percentile(F.col(f"c_{c}_rank"), F.col("group_n")) * w for c, w in P.SCORE_WEIGHTS.items()}
    staged = ranked.select(*by, "symbol", "knife", *[v.alias(f"part_{c}") for c, v in parts.items()])
    total = F.col("part_valuation")
    for c in COMPONENTS[1:]:
        total = total + F.col(f"part_{c}")
    composite = staged.withColumn("composite", total + F.col("knife"))
    if not whole:
        composite = materialize(composite, "composite")  # read by every pass of the second ranking
    keep = ["knife", *[f"part_{c}" for c in COMPONENTS]]
    final = rank_columns(composite, by, ["symbol"], ["composite"], keep=keep, whole=whole)
    pct = clamp(to_percentile(F.col("composite_rank"), F.col("group_n")), 0.0, 100.0)
    return final.select(*by, "symbol", *keep, pct.alias("raw_score")).withColumn("score", round1(F.col("raw_score"))).drop(
        "raw_score"
    )


def value_score(
    rows: DataFrame,
    by: Sequence[str] = ("anchor",),
    min_cap: float = P.SCORE_MIN_CAP,
    min_volume: float = P.SCORE_MIN_VOLUME,
) -> DataFrame:
    """Score of the rows that pass the gates, with the weighted parts (one decimal) and the penalty."""
    pool = with_components(eligible(rows, min_cap, min_volume)).withColumn("knife", knife_penalty())
    scored = _score(pool, list(by), fits(rows, by))
    return scored.withColumns({f"part_{c}": round1(F.col(f"part_{c}")) for c in COMPONENTS})


def panel_score(rows: DataFrame, by: Sequence[str] = ("anchor",)) -> DataFrame:
    """Gated score where the symbol passes the gates, else its score among all symbols.

    Both cross-sections are ranked in one pass, told apart by ``pool`` (1 gated, 0 everyone).
    """
    by = list(by)
    whole = fits(rows, by)
    base = with_components(rows.filter(scorable())).withColumn("knife", knife_penalty())
    gated = liquid(P.SCORE_MIN_CAP, P.SCORE_MIN_VOLUME)
    pools = F.when(gated, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    narrow = [*by, "symbol", "knife", *[f"c_{c}" for c in COMPONENTS]]
    both = base.withColumn("pool", F.explode(pools)).select("pool", *narrow)
    scored = _score(both, ["pool", *by], whole)
    best = scored.groupBy(*by, "symbol").agg(F.max_by("score", "pool").alias("score"))
    return rows.join(best, [*by, "symbol"])


def feature_value(name: str) -> Column:
    if name == "abs_median_dist_3y":
        return F.abs(F.col("median_dist_3y")).cast("double")
    return F.col(name).cast("double")


def fill_upper_median(long: DataFrame, by: Sequence[str], whole: bool | None = None) -> DataFrame:
    """Replace a null ``v`` by the upper median of its group (0 when the whole group is null).

    ``long`` has by + name + v. The median is the entry at index n // 2 of the sorted values,
    found from distinct-value counts, so no group is collected.
    """
    keys = [*by, "name"]
    counts = long.filter(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    placed = count_before(counts, keys, "v", whole=whole)
    middle = F.floor(F.col("total") / 2)
    medians = placed.filter((F.col("before") <= middle) & (middle < F.col("before") + F.col("n"))).select(
        *keys, F.col("v").alias("__median")
    )
    return (
        long.join(medians, keys, "left")
        .withColumn("v", F.coalesce("v", "__median", F.lit(0.0)))
        .drop("__median")
    )


def oriented_ranks(rows: DataFrame, by: Sequence[str], whole: bool | None = None) -> DataFrame:
    """(by, symbol, name, x): every feature's cross-sectional rank in [0, 1], oriented by sign."""
    by = list(by)
    whole = fits(rows, by) if whole is None else whole
    pairs = F.array(
        *[F.struct(F.lit(n).alias("name"), feature_value(n).alias("v")) for n in P.FEATURE_DIRECTIONS]
    )
    long = rows.select(*by, "symbol", F.explode(pairs).alias("p")).select(*by, "symbol", "p.name", "p.v")
    keys = [*by, "name"]
    filled = fill_upper_median(long, by, whole).withColumn("v", F.col("v") + F.lit(0.0))
    if whole:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        ranked = filled.select(*keys, "symbol", to_percentile(average_rank("v", keys), n, 1.0).alias("pct"))
    else:
        ranks = rank_columns(materialize(filled, "filled"), keys, ["symbol"], ["v"], whole=False)
        ranked = ranks.select(*keys, "symbol", to_percentile(F.col("v_rank"), F.col("group_n"), 1.0).alias("pct"))
    up = F.col("name").isin([n for n, d in P.FEATURE_DIRECTIONS.items() if d > 0])
    return ranked.select(*by, "symbol", "name", F.when(up, F.col("pct")).otherwise(1.0 - F.col("pct")).alias("x"))


def learned_score(rows: DataFrame, weights: DataFrame, by: Sequence[str] = ("anchor",)) -> DataFrame:
    """Learned 0-100 score: standardised oriented ranks times the artifact's weights, ranked again.

    ``weights`` has one row per feature (name, weight, mean, scale): 26 rows, broadcast.
    """
    by = list(by)
    whole = fits(rows, by)
    scale = F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    z = (F.col("x") - F.col("mean")) / scale
    raw = (
        oriented_ranks(rows, by, whole)
        .join(F.broadcast(weights.select("name", "weight", "mean", "scale")), "name")
        .groupBy(*by, "symbol")
        .agg(F.round(F.sum(F.col("weight") * z), 12).alias("raw"))
    )
    ranked = rank_columns(raw, by, ["symbol"], ["raw"], whole=whole)
    pct = clamp(to_percentile(F.col("raw_rank"), F.col("group_n"), 1.0) * 100.0, 0.0, 100.0)
    return ranked.select(*by, "symbol", pct.alias("__s")).withColumn("score", round1(F.col("__s"))).drop("__s")
