"""Per-symbol series: lows, running extrema, distance history and zone visits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import distance_pct
from tidemark.functions.quantiles import position_quantile

ZONE_PCT = 15.0
ZONE_RALLY_PCT = 30.0
ZONE_SPAN = 180
ZONE_SEPARATION = 45


def lows(candles: DataFrame, event_start: dt.date, cutoff: dt.date) -> DataFrame:
    """All-time low and low since the event start, falling back to the all-time low."""
    return (
        candles.filter(F.col("ts") <= F.lit(cutoff))
        .groupBy("symbol")
        .agg(F.min("low").alias("atl"), F.min(F.when(F.col("ts") >= F.lit(event_start), F.col("low"))).alias("e"))
        .select("symbol", "atl", F.coalesce("e", "atl").alias("event_low"))
    )


def custom_low(coins: DataFrame, candles: DataFrame, start: dt.date) -> DataFrame:
    """Event low from a custom start; only replaces the stored low where one exists."""
    fresh = candles.filter(F.col("ts") >= F.lit(start)).groupBy("symbol").agg(F.min("low").alias("__low"))
    out = coins.join(fresh, "symbol", "left").withColumn("event_low", F.coalesce("__low", "event_low"))
    return out.withColumn("distance", distance_pct(F.col("current_price"), F.col("event_low"))).drop("__low")


def latest(candles: DataFrame, cutoff: dt.date | None = None) -> DataFrame:
    rows = candles if cutoff is None else candles.filter(F.col("ts") <= F.lit(cutoff))
    return rows.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


def latest_n(candles: DataFrame, n: int) -> DataFrame:
    """The last n rows of every symbol (the rank limit is cut on the map side)."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return candles.withColumn("__p", place).filter(F.col("__p") <= n).drop("__p")


def dip_history(candles: DataFrame, event_start: dt.date, limit: int | None = None) -> DataFrame:
    """Running lows and distances of every candle, optionally the last ``limit`` per symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = candles.select(
        "symbol",
        "ts",
        "close",
        F.min("low").over(whole).alias("all_time_low"),
        F.min(F.when(F.col("ts") >= F.lit(event_start), F.col("low"))).over(whole).alias("e"),
    ).withColumn("event_low", F.coalesce("e", "all_time_low"))
    out = rows.select(
        "symbol",
        "ts",
        "close",
        "all_time_low",
        "event_low",
        distance_pct(F.col("close"), F.col("event_low")).alias("distance_event"),
        distance_pct(F.col("close"), F.col("all_time_low")).alias("distance_atl"),
    )
    return out if limit is None else latest_n(out, limit)


def running_extrema(candles: DataFrame, event_start: dt.date) -> DataFrame:
    """Running low/high with their row numbers, close range and event low."""
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = candles.select("symbol", "ts", "close", "low", F.row_number().over(w).alias("rn"))
    return rows.select(
        "symbol",
        "ts",
        "rn",
        F.min("low").over(whole).alias("atl"),
        F.min(F.struct("low", "rn")).over(whole)["rn"].alias("atl_rn"),
        F.min("close").over(whole).alias("min_close"),
        F.max("close").over(whole).alias("max_close"),
        F.max(F.struct("close", "rn")).over(whole)["rn"].alias("ath_rn"),
        F.coalesce(
            F.min(F.when(F.col("ts") >= F.lit(event_start), F.col("low"))).over(whole), F.min("low").over(whole)
        ).alias("event_low"),
    )


def trailing_stats(candles: DataFrame) -> DataFrame:
    """Every-row trends, mean flag, volatilities and traded value."""
    w = Window.partitionBy("symbol").orderBy("ts")
    close, before = F.col("close"), F.lag("close").over(w)
    rows = candles.select(
        "symbol",
        "ts",
        "close",
        "volume",
        F.row_number().over(w).alias("rn"),
        F.when((before > 0) & (close > 0), F.log(close / before)).alias("lr"),
        *[F.lag("close", k).over(w).alias(f"c{k}") for k in (7, 30, 90, 180, 365)],
    )
    trail = lambda n: w.rowsBetween(-(n - 1), 0)
    return rows.select(
        "symbol",
        "ts",
        "rn",
        *[F.when(F.col(f"c{k}") != 0, (close / F.col(f"c{k}") - 1.0) * 100.0).alias(f"trend_{k}d") for k in (7, 30, 90, 180, 365)],
        F.when(F.col("rn") >= 60, close > F.avg("close").over(trail(200))).alias("above_sma200"),
        F.when(F.count("lr").over(trail(30)) >= 10, F.stddev_samp("lr").over(trail(30))).alias("volatility_30d"),
        F.when(F.count("lr").over(trail(90)) >= 30, F.stddev_samp("lr").over(trail(90))).alias("volatility_90d"),
        F.avg(F.coalesce(F.col("volume"), F.lit(0.0)) * close).over(trail(30)).alias("dollar_volume_30d"),
    )


def relative_performance(candles: DataFrame, symbols: list[str], limit: int) -> DataFrame:
    """Close over the first close of the shown range, for a few chosen symbols."""
    shown = latest_n(candles.filter(F.col("symbol").isin(symbols)).select("symbol", "ts", "close"), limit)
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("close").over(w)
    base = F.when(first == 0, F.lit(1.0)).otherwise(first)
    return shown.select("symbol", "ts", (F.col("close") / base).alias("value"))


def distribution_strip(candles: DataFrame, price: DataFrame, window: int = 1095, minimum: int = 30) -> DataFrame:
    """Quantiles of the last closes per symbol and the percentile of the given price.

    At most ``window`` closes per symbol are ever gathered.
    """
    recent = latest_n(candles.select("symbol", "ts", "close"), window)
    stats = recent.join(price.select("symbol", F.col("current_price").alias("p")), "symbol").groupBy("symbol").agg(
        F.sort_array(F.collect_list("close")).alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("close") <= F.col("p")).alias("le"),
        F.first("p").alias("p"),
    )
    s = F.col("s")
    return stats.filter(F.col("n") >= minimum).select(
        "symbol",
        "n",
        F.element_at(s, 1).alias("min"),
        *[position_quantile(s, q).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)],
        F.element_at(s, -1).alias("max"),
        F.when(F.col("p") > 0, F.floor(100 * F.col("le") / F.col("n") + 0.5)).alias("percentile"),
    )


def zone_visits(history: DataFrame) -> DataFrame:
    """Entries into the low zone that rally within the next points of the series.

    ``history`` has symbol, ts and distance_event. The next search starts at the zone's end or
    after the separation span, whichever is later; that step is a fold over the (few) zone rows.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = w.rowsBetween(0, ZONE_SPAN - 1)
    flagged = history.select(
        "symbol", "ts", (F.row_number().over(w) - 1).alias("i"), "distance_event", F.max("distance_event").over(ahead).alias("peak")
    ).withColumn("outside", F.col("distance_event") > ZONE_PCT)
    # First row at or after each row that lies outside the zone; the series end when there is none.
    later = w.rowsBetween(0, Window.unboundedFollowing)
    exits = flagged.withColumn(
        "exit", F.coalesce(F.min(F.when(F.col("outside"), F.col("i"))).over(later), F.max("i").over(Window.partitionBy("symbol")) + 1)
    )
    zone = exits.filter(~F.col("outside")).groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("i", "exit", "peak", "ts"))).alias("rows")
    )
    zero = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<struct<ts:date,peak:double>>)").alias("out"))
    folded = F.aggregate(
        "rows",
        zero,
        lambda acc, r: F.when(r["i"] < acc["next"], acc).otherwise(
            F.struct(
                F.greatest(r["exit"], r["i"] + ZONE_SEPARATION).alias("next"),
                F.when(
                    r["peak"] >= ZONE_RALLY_PCT,
                    F.array_append(acc["out"], F.struct(r["ts"].alias("ts"), r["peak"].alias("peak"))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return zone.select("symbol", F.explode(folded).alias("v")).select("symbol", "v.ts", "v.peak")


def gaps(rows: DataFrame, days: int) -> DataFrame:
    """Symbols with, and total number of, day gaps above a threshold."""
    w = Window.partitionBy("symbol").orderBy("ts")
    gap = F.datediff("ts", F.lag("ts").over(w))
    wide = rows.select("symbol", gap.alias("gap")).filter(F.col("gap") > days)
    per = wide.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("symbols_with_gaps"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_gaps"))
