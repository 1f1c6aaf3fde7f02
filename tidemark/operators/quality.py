"""Data quality report and provenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.ranks import count_before
from tidemark.operators.series import gaps
from tidemark.sources.sinks import tidy_report


def universe_counts(coins: DataFrame) -> DataFrame:
    return coins.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("delisted_at").isNull()).alias("active"),
        F.count_if(F.col("delisted_at").isNotNull()).alias("delisted"),
        F.count_if("is_stable").alias("stable"),
        F.count("market_id").alias("with_id"),
    )


def candle_coverage(candles: DataFrame) -> DataFrame:
    """Candle counts per symbol: median and p10 at index min(n - 1, floor(f * n)).

    The order statistics come from distinct counts and their running totals, so the list of
    symbols is never gathered.
    """
    per = candles.groupBy("symbol").agg(F.count(F.lit(1)).alias("candles"))
    counts = per.groupBy(F.lit(0).alias("k"), "candles").agg(F.count(F.lit(1)).alias("n"))
    placed = count_before(counts, ["k"], "candles")

    def at(fraction: float):
        index = F.least(F.col("total") - 1, F.floor(F.lit(fraction) * F.col("total")))
        hit = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(hit, F.col("candles")))

    return placed.agg(
        F.sum("n").alias("symbols"),
        F.sum(F.col("n") * F.col("candles")).alias("rows"),
        at(0.5).alias("median_candles"),
        at(0.1).alias("p10_candles"),
        F.coalesce(F.sum(F.when(F.col("candles") >= 400, F.col("n"))), F.lit(0)).alias("symbols_ge_400"),
        F.coalesce(F.sum(F.when(F.col("candles") >= 1095, F.col("n"))), F.lit(0)).alias("symbols_ge_1095"),
    )


def candle_gaps(candles: DataFrame) -> DataFrame:
    return gaps(candles, P.GAP_DAYS)


def market_history_report(archive: DataFrame, coins: DataFrame) -> DataFrame:
    """Archive size, share of identified symbols covered, day range and gaps."""
    per = archive.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    base = per.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("n") >= 400).alias("symbols_ge_400"),
        F.min("a").alias("first_day"),
        F.max("b").alias("last_day"),
    )
    ids = coins.select(F.count("market_id")).scalar()
    g = gaps(archive, P.GAP_DAYS)
    return base.select(
        "*",
        F.when(ids > 0, F.round(F.col("symbols") / ids, 3)).otherwise(0.0).alias("coverage"),
        g.select("symbols_with_gaps").scalar().alias("symbols_with_gaps"),
        g.select("total_gaps").scalar().alias("total_gaps"),
    )


def liquidity_staleness(coins: DataFrame, now: dt.date) -> DataFrame:
    active = F.col("delisted_at").isNull()
    stale = F.col("last_updated").isNull() | (F.col("last_updated") < F.date_sub(F.lit(now), 7))
    return coins.agg(
        F.count_if(active & F.col("market_cap").isNotNull()).alias("active_with_cap"),
        F.count_if(active & stale).alias("active_stale"),
        F.count_if(active & F.col("current_price").isNull()).alias("active_without_price"),
    )


def delisted_list(coins: DataFrame) -> DataFrame:
    return coins.filter(F.col("delisted_at").isNotNull()).select("symbol", "delisted_at").orderBy("delisted_at", "symbol")


def panel_coverage(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("anchor").alias("anchors"),
        F.min("anchor").alias("first_anchor"),
        F.max("anchor").alias("last_anchor"),
        F.countDistinct("symbol").alias("symbols"),
        F.avg(F.col("market_cap_pit").isNotNull().cast("double")).alias("archived_share"),
    )


def data_fingerprint(candles: DataFrame, coins: DataFrame) -> DataFrame:
    """Latest candle, tracked symbols and an order-independent content hash."""
    row = F.sha2(F.concat_ws("|", "symbol", F.col("ts").cast("string"), F.round(F.col("close") * 1e6).cast("long")), 256)
    chunk = F.conv(F.substring(row, 1, 8), 16, 10).cast("long")
    tracked = coins.select(F.count(F.lit(1))).scalar()
    return candles.agg(
        F.max("ts").alias("latest_candle"), F.count(F.lit(1)).alias("rows"), F.sum(chunk).alias("content_hash")
    ).withColumn("tracked", tracked)


def quality_report(candles: DataFrame, coins: DataFrame, archive: DataFrame, now: dt.date) -> DataFrame:
    """(section, metric, value) of the whole data set: universe, candles with gaps, archive, liquidity, the delisted
    symbols with their dates, and the provenance of the data (latest candle, rows and content hash)."""
    gone = delisted_list(coins).select(
        F.lit("delisted_symbols").alias("section"), F.col("symbol").alias("metric"), F.col("delisted_at").cast("string").alias("value")
    )
    parts = [
        ("universe", universe_counts(coins)),
        ("candles", candle_coverage(candles)),
        ("candle_gaps", candle_gaps(candles)),
        ("market_history", market_history_report(archive, coins)),
        ("liquidity", liquidity_staleness(coins, now)),
        ("provenance", data_fingerprint(candles, coins)),
    ]
    return tidy_report(parts).unionByName(gone)
