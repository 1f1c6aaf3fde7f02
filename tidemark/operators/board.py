"""The board: one row per live symbol, its filters, summaries and leaderboards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions import symbols as S
from tidemark.functions.numeric import distance_pct, falsy
from tidemark.functions.select import quantiles
from tidemark.operators.asof import close_before
from tidemark.operators.calendar import Calendar
from tidemark.operators.lookback import lookback_stats
from tidemark.operators.score import COMPONENTS, value_score
from tidemark.session import materialize

MIN_BUBBLE, MAX_BUBBLE = 10.0, 100.0


def live_coins(coins: DataFrame) -> DataFrame:
    return coins.filter(F.col("current_price").isNotNull() & F.col("delisted_at").isNull())


def bubble_size(board: DataFrame) -> DataFrame:
    """Square-root size of the cap against the largest cap (one scalar, not a window)."""
    top = board.filter(F.col("market_cap") > 0).select(F.max("market_cap")).scalar()
    size = MIN_BUBBLE + F.sqrt("market_cap") / F.sqrt(top) * (MAX_BUBBLE - MIN_BUBBLE)
    return board.withColumn(
        "bubble_size", F.round(F.when(F.col("market_cap") > 0, size).otherwise(F.lit(MIN_BUBBLE)), 2)
    )


def usd_price(board: DataFrame, rates: DataFrame, day: dt.date, price: str = "price") -> DataFrame:
    """Price in the quote currency at the last rate on or before ``day``."""
    rate = rates.filter(F.col("ts") <= F.lit(day)).select(F.max_by("close", "ts")).scalar()
    usable = ~falsy(F.col(price)) & ~falsy(rate)
    return board.withColumn("price_usd", F.when(usable, F.round(F.col(price) * rate, 10)))


def board_as_of(
    candles: DataFrame, coins: DataFrame, rates: DataFrame, day: dt.date, event_start: dt.date = P.DEFAULT_EVENT_CUTOFF
) -> DataFrame:
    """The board as of a date: only candles up to the day, symbols without a price dropped.

    Candles of symbols that are not live are left out before any statistic.
    """
    identity = live_coins(coins).select(
        "symbol", "name", "market_id", "listing_date", "is_pre_cutoff", "is_stable", "market_cap", "volume_24h"
    )
    traded = candles.join(identity.select("symbol"), "symbol", "left_semi")
    stats = materialize(lookback_stats(traded, Calendar.once(day), event_start), "board-stats")
    before = close_before(traded, {"price_7d": 7, "price_30d": 30}, day).drop("price", "last_ts")
    rows = stats.join(identity, "symbol").join(before, "symbol", "left")
    rows = rows.withColumns({"cap": F.col("market_cap"), "volume": F.col("volume_24h"), "base_asset": S.base_asset(F.col("symbol"))})
    scored = value_score(rows).select(
        "symbol",
        F.col("score").alias("value_score"),
        *[f"part_{c}" for c in COMPONENTS],
        "knife",
    )
    board = rows.drop("anchor").join(scored, "symbol", "left")
    return usd_price(bubble_size(board), rates, day)


def trend_delta(now: Column, then: Column, low: Column) -> Column:
    """Change of the distance to the low, in percentage points."""
    known = ~(falsy(now) | falsy(then) | falsy(low))
    return F.when(known, (now - then) / low * 100.0)


def drop_to_dip(distance: Column) -> Column:
    return distance / (F.lit(100.0) + distance) * 100.0


def matches_listing(listing: Column, mode: str, cutoff: dt.date) -> Column:
    if mode == "any":
        return F.lit(True)
    old = listing < F.lit(cutoff)
    return F.coalesce(old if mode == "old" else ~old, F.lit(False))


def _filters(
    watched: Column, search: str, min_cap: float, min_volume: float, listing: str, cutoff: dt.date, stables: bool, watch_only: bool
) -> list[tuple[str, Column]]:
    """(reason, passes) in the order in which a hidden row is explained."""
    query = search.strip().lower()
    text = F.lower(F.concat_ws(" ", "symbol", F.coalesce("name", F.lit("")), F.coalesce("base_asset", F.lit(""))))
    zero = F.lit(0.0)
    return [
        ("stables", F.lit(True) if stables else ~F.coalesce("is_stable", F.lit(False))),
        ("listing", matches_listing(F.col("listing_date"), listing, cutoff)),
        ("marketCap", F.coalesce("market_cap", zero) >= min_cap),
        ("volume", F.coalesce("volume_24h", zero) >= min_volume),
        ("watchlist", watched if watch_only else F.lit(True)),
        ("search", text.contains(query) if query else F.lit(True)),
    ]


def _marked(board: DataFrame, watchlist: DataFrame, **options) -> tuple[DataFrame, list[tuple[str, Column]]]:
    flags = watchlist.select("symbol").distinct().withColumn("__w", F.lit(True))
    marked = board.join(flags, "symbol", "left").withColumn("__w", F.coalesce("__w", F.lit(False)))
    defaults = {"search": "", "min_cap": 0.0, "min_volume": 0.0, "listing": "any", "cutoff": P.DEFAULT_EVENT_CUTOFF}
    defaults |= {"stables": False, "watch_only": False}
    return marked, _filters(F.col("__w"), **(defaults | options))


def board_filter(board: DataFrame, watchlist: DataFrame, **options) -> DataFrame:
    marked, filters = _marked(board, watchlist, **options)
    keep = F.lit(True)
    for _, passes in filters:
        keep = keep & passes
    return marked.filter(keep).drop("__w")


def hidden_reasons(board: DataFrame, watchlist: DataFrame, **options) -> DataFrame:
    """Rows per first failing filter; visible rows are counted as ``visible``."""
    marked, filters = _marked(board, watchlist, **options)
    chain = F.when(~filters[0][1], filters[0][0])
    for reason, passes in filters[1:]:
        chain = chain.when(~passes, reason)
    return marked.groupBy(chain.otherwise("visible").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def leaderboard(board: DataFrame, mode: str, window: str = "3y", use_atl: bool = False, limit: int = 10) -> DataFrame:
    """Top rows of one of five modes; rows without the metric are left out."""
    low = "atl" if use_atl else "event_low"
    metrics = {
        "closest": (F.col("distance_atl" if use_atl else "distance"), False),
        "falling": (trend_delta(F.col("price"), F.col("price_7d"), F.col(low)), False),
        "cheapest": (F.col(f"valuation_pct_{window}"), False),
        "basing": (F.col("basing_pct_90d"), True),
        "value": (F.col("value_score"), True),
    }
    metric, descending = metrics[mode]
    rows = board.select("symbol", metric.alias("metric")).filter(F.col("metric").isNotNull())
    order = F.desc("metric") if descending else F.asc("metric")
    return rows.orderBy(order, "symbol").limit(limit).withColumn("mode", F.lit(mode))


def table_sort(board: DataFrame, metric: Column, descending: bool) -> DataFrame:
    """Order by any metric with missing values last in both directions."""
    order = metric.desc_nulls_last() if descending else metric.asc_nulls_last()
    return board.orderBy(order, "symbol")


def summary_strip(board: DataFrame, distance: str = "distance") -> DataFrame:
    """Counts and the exact median, which is selected by counting passes and never held in one buffer."""
    d = F.col(distance)
    (median,) = quantiles(board, distance, (0.5,))
    return board.agg(
        F.count(F.lit(1)).alias("tracked"),
        F.count_if(d <= 25).alias("near25"),
        F.count_if(d <= 50).alias("near50"),
    ).withColumn("median", F.lit(median).cast("double"))


def robust_domain(board: DataFrame, distance: str = "distance") -> DataFrame:
    """Colour, axis and bar limits from robust percentiles, and the rows beyond the axis.

    ``axis_all`` is the axis that holds every row, for callers with few of them. The percentiles are exact.
    """
    d = F.col(distance)
    p90, p95 = (F.lit(q).cast("double") for q in quantiles(board, distance, (0.9, 0.95)))
    axis = F.greatest(p95, F.lit(50.0))
    stats = board.agg(F.max(d).alias("top"), F.count_if(d > axis).alias("overflow"))
    return stats.select(
        F.greatest(p90, F.lit(25.0)).alias("colour_max"),
        axis.alias("axis_max"),
        F.greatest("top", F.lit(1.0)).alias("axis_all"),
        F.greatest(p95, F.lit(5.0)).alias("bar_max"),
        "overflow",
    )


def cap_share(board: DataFrame, distance: str = "distance") -> DataFrame:
    rows = board.filter((F.col("market_cap") > 0) & F.col(distance).isNotNull())
    total = rows.select(F.sum("market_cap")).scalar()
    return rows.select("symbol", (F.col("market_cap") / total).alias("share"))


def watchlist_board(watchlist: DataFrame, board: DataFrame) -> DataFrame:
    return watchlist.join(board.select("symbol", "price", "distance", "distance_atl", "market_cap"), "symbol", "left")


def meta_summary(coins: DataFrame, candles: DataFrame, rates: DataFrame) -> DataFrame:
    counts = coins.agg(
        F.count_if(F.col("current_price").isNotNull() & F.col("delisted_at").isNull()).alias("tracked"),
        F.count_if(F.col("delisted_at").isNotNull()).alias("delisted"),
    )
    last = candles.select(F.max("ts")).scalar()
    rate = rates.select(F.max_by("close", "ts")).scalar()
    return counts.select("tracked", "delisted", last.alias("last_candle"), rate.alias("quote_rate"))


def price_columns(coins: DataFrame, candles: DataFrame, event_start: dt.date, end: dt.date) -> DataFrame:
    """Live board prices: lows, distances and the closes 7 and 30 days before the last candle."""
    from tidemark.operators.series import lows

    back = close_before(candles, {"price_7d": 7, "price_30d": 30})
    rows = coins.join(lows(candles, event_start, end), "symbol").join(back, "symbol")
    return rows.withColumns(
        {
            "distance": distance_pct(F.col("price"), F.col("event_low")),
            "distance_atl": distance_pct(F.col("price"), F.col("atl")),
        }
    )


