"""The point-in-time panel and the tables derived from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators.asof import asof_market, daily_rates
from tidemark.operators.calendar import Calendar, cover_anchors, history_bounds
from tidemark.operators.lookback import EXTRAS, STATS, lookback_stats
from tidemark.operators.score import learned_score, panel_score
from tidemark.session import materialize

PANEL_COLUMNS = ["frequency", "anchor", "symbol", "score", "distance", "price", "cap", "volume", *STATS, *EXTRAS]


def panel_inputs(
    candles: DataFrame,
    archive: DataFrame,
    coins: DataFrame,
    calendar: Calendar,
    event_start: dt.date = P.DEFAULT_EVENT_CUTOFF,
) -> DataFrame:
    """Unscored panel rows: statistics at every anchor with cap and volume known at that anchor."""
    universe = coins.filter(~F.coalesce("is_stable", F.lit(False))).select("symbol", "market_cap", "volume_24h")
    members = candles.join(universe.select("symbol"), "symbol", "left_semi")
    # The warm-up equals the three-year minimum, so the valuation percentile is always present here.
    stats = lookback_stats(members, calendar, event_start, P.WARMUP_CANDLES)
    priced = asof_market(stats, archive, universe, calendar)
    return priced.withColumn("frequency", F.lit(calendar.frequency)).withColumn("is_stable", F.lit(False))


def point_in_time_panel(
    candles: DataFrame,
    archive: DataFrame,
    coins: DataFrame,
    calendar: Calendar,
    event_start: dt.date = P.DEFAULT_EVENT_CUTOFF,
    model: DataFrame | None = None,
) -> DataFrame:
    """One scored row per (anchor, symbol). ``model`` switches to the learned score's weights."""
    rows = materialize(panel_inputs(candles, archive, coins, calendar, event_start), "panel-inputs")
    if model is None:
        scored = panel_score(rows)
    else:
        scored = rows.join(learned_score(rows, model), ["anchor", "symbol"])
    return scored.select(*PANEL_COLUMNS, "market_cap_pit", "volume_pit")


def panel_calendar(
    candles: DataFrame, frequency: str, end: dt.date | None = None, earliest: dt.date | None = None
) -> Calendar:
    first, last = history_bounds(candles)
    return Calendar.for_history(frequency, first, end or last, earliest)


def numbered(panel: DataFrame, calendar: Calendar) -> DataFrame:
    """Panel rows with the index of their anchor in the calendar (broadcast: one row per anchor)."""
    anchors = calendar.frame(panel.sparkSession).select("anchor", "idx")
    return panel.join(F.broadcast(anchors), "anchor")


def breadth(panel: DataFrame) -> DataFrame:
    """Share of symbols above their 200-candle mean, unknowns excluded."""
    return panel.groupBy("anchor").agg(F.avg(F.col("above_sma200").cast("double")).alias("breadth"))


def forward_pairs(
    panel: DataFrame, calendar: Calendar, step: int = 1, columns: tuple[str, ...] = (), both: bool = True
) -> DataFrame:
    """Rows of an anchor joined with the same symbol ``step`` anchors later.

    The base price must be non-zero, and with ``both`` the later one too.
    """
    rows = numbered(panel, calendar)
    now = rows.filter(F.col("price") != 0).select("idx", "anchor", "symbol", "price", *columns)
    later = (rows.filter(F.col("price") != 0) if both else rows).select(
        (F.col("idx") - step).alias("idx"), "symbol", F.col("price").alias("next_price")
    )
    return now.join(later, ["idx", "symbol"]).withColumn("ret", F.col("next_price") / F.col("price") - 1.0)


def forward_returns(
    panel: DataFrame, calendar: Calendar, step: int = 1, min_universe: int = P.MIN_UNIVERSE, columns: tuple[str, ...] = ()
) -> DataFrame:
    """Forward returns of the anchors with at least ``min_universe`` symbols at both ends."""
    pairs = forward_pairs(panel, calendar, step, columns)
    wide = pairs.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_universe)
    return pairs.join(wide.select("idx"), "idx", "left_semi")


def alt_index(panel: DataFrame, calendar: Calendar) -> DataFrame:
    """Equal-weight index of the panel compounded over anchors, with its trend against a short mean.

    Aggregated to one row per anchor before any window, so the ordered part is calendar-sized.
    """
    pairs = forward_pairs(panel, calendar, both=False)
    returns = pairs.groupBy((F.col("idx") + 1).alias("idx")).agg(F.avg("ret").alias("alt_return"))
    anchors = calendar.frame(panel.sparkSession).select("frequency", "anchor", "idx")
    w = Window.partitionBy("frequency").orderBy("idx")
    level = F.product(1.0 + F.coalesce("alt_return", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    recent = w.rowsBetween(-(P.REGIME_SMA_ANCHORS - 1), 0)
    return (
        anchors.join(returns, "idx", "left")
        .withColumn("alt_index", level)
        .withColumn("sma", F.avg("alt_index").over(recent))
        .select(
            "frequency",
            "anchor",
            "idx",
            "alt_return",
            "alt_index",
            F.when(F.col("idx") >= 2, F.col("alt_index") > F.col("sma")).alias("alt_above_sma"),
            F.when(F.col("sma") != 0, F.col("alt_index") / F.col("sma") - 1.0).alias("alt_trend"),
        )
    )


def regime(panel: DataFrame, calendar: Calendar) -> DataFrame:
    """Universe regime per anchor: index, trend flag and breadth."""
    return alt_index(panel, calendar).join(breadth(panel), "anchor", "left")


def quote_regime(rates: DataFrame, calendar: Calendar) -> DataFrame:
    """Quote-series return over 30 and 90 days and its 200-row mean flag, as of each anchor."""
    w = Window.partitionBy(F.lit(0)).orderBy("ts")
    rows = rates.select("ts", "close", F.avg("close").over(w.rowsBetween(-199, 0)).alias("sma"))
    at = cover_anchors(rows.withColumn("k", F.lit(0)), calendar, ["k"]).select(
        "anchor", F.col("close").alias("now"), "sma"
    )
    daily = daily_rates(rates, calendar.end)
    for days in (30, 90):
        back = daily.select(F.date_add("day", days).alias("anchor"), F.col("rate").alias(f"past_{days}"))
        at = at.join(back, "anchor", "left")
    return at.select(
        "anchor",
        *[
            F.when(F.col(f"past_{d}") != 0, F.col("now") / F.col(f"past_{d}") - 1.0).alias(f"quote_return_{d}d")
            for d in (30, 90)
        ],
        F.when(F.col("sma") != 0, F.col("now") > F.col("sma")).alias("quote_above_sma200"),
    )


def feature_rows(panel: DataFrame, rates: DataFrame, calendar: Calendar) -> DataFrame:
    """Feature store rows: panel, archived liquidity, quote regime and universe regime.

    Both regime tables have one row per anchor; Spark broadcasts them by their known size.
    """
    alt = regime(panel, calendar).select("anchor", "alt_above_sma", "alt_trend", "breadth")
    quote = quote_regime(rates, calendar)
    return (
        panel.withColumnsRenamed({"cap": "cap_current", "volume": "volume_current", "market_cap_pit": "market_cap_pit"})
        .join(quote, "anchor", "left")
        .join(alt, "anchor", "left")
    )


