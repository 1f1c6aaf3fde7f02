"""As-of joins against a small daily series and against per-symbol archives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import Calendar, cover_anchors


def daily_rates(rates: DataFrame, until: dt.date, value: str = "close") -> DataFrame:
    """Dense (day, rate): every rate row is repeated until the day before the next one.

    The series has one row per day of the calendar, so it stays small whatever the number of
    symbols; an as-of lookup against it is then a plain equality join on the day.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("ts")
    last = F.greatest(F.coalesce(F.date_sub(F.lead("ts").over(w), 1), F.lit(until)), F.col("ts"))
    spans = rates.select("ts", F.col(value).alias("rate"), last.alias("last"))
    return spans.select(F.explode(F.sequence("ts", "last")).alias("day"), "rate")


def asof_rate(times: DataFrame, rates: DataFrame, ts: str = "ts", policy: str = "strict") -> DataFrame:
    """Add ``rate``: the rate at or before ``ts``, also after the last one.

    Before the first rate ``strict`` gives null and ``clamp`` gives the first rate. The distinct days of
    ``times`` and the rates are one calendar-sized series, whose last known value is carried forward.
    """
    if policy not in ("strict", "clamp"):
        raise ValueError("policy must be strict or clamp")
    days = times.select(F.col(ts).alias("__day")).distinct().withColumns({"__rate": F.lit(None).cast("double"), "__asked": F.lit(True)})
    known = rates.select(F.col("ts").alias("__day"), F.col("close").cast("double").alias("__rate"), F.lit(False).alias("__asked"))
    carried = F.last("__rate", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("__day"))
    lookup = days.unionByName(known).withColumn("rate", carried).filter("__asked").select(F.col("__day").alias(ts), "rate")
    joined = times.join(lookup, ts, "left")
    if policy == "clamp":
        joined = joined.withColumn("rate", F.coalesce("rate", rates.select(F.min_by("close", "ts")).scalar()))
    return joined


def asof_market(points: DataFrame, archive: DataFrame, coins: DataFrame, calendar: Calendar) -> DataFrame:
    """Add cap and volume as of ``anchor``: last archive row, then the current values.

    The archive row is chosen by date alone; a null inside it falls through to the coin row.
    """
    covered = cover_anchors(archive.select("symbol", "ts", "market_cap", "volume_24h"), calendar, ["symbol"])
    archived = covered.select(
        "symbol", "anchor", F.col("market_cap").alias("market_cap_pit"), F.col("volume_24h").alias("volume_pit")
    )
    current = coins.select("symbol", F.col("market_cap").alias("__cap"), F.col("volume_24h").alias("__vol"))
    return (
        points.join(archived, ["symbol", "anchor"], "left")
        .join(current, "symbol", "left")
        .withColumn("cap", F.coalesce("market_cap_pit", "__cap"))
        .withColumn("volume", F.coalesce("volume_pit", "__vol"))
        .drop("__cap", "__vol")
    )


def history_in_quote(candles: DataFrame, rates: DataFrame) -> DataFrame:
    """Candles times the last known rate; days before the first rate are dropped."""
    priced = asof_rate(candles, rates).filter(F.col("rate").isNotNull())
    return priced.select(
        "symbol", "ts", *[(F.col(c) * F.col("rate")).alias(c) for c in ("open", "high", "low", "close", "volume")]
    )


def close_before(candles: DataFrame, offsets: dict[str, int], cutoff: dt.date | None = None) -> DataFrame:
    """Latest close and closes ``days`` before it, per symbol, in one aggregate.

    With a cutoff the offsets count from the cutoff, otherwise from each symbol's last candle.
    """
    if cutoff is not None:
        rows = candles.filter(F.col("ts") <= F.lit(cutoff)).withColumn("__ref", F.lit(cutoff))
    else:
        w = Window.partitionBy("symbol")
        rows = candles.withColumn("__ref", F.max("ts").over(w))
    aggs = [F.max_by("close", "ts").alias("price"), F.max("ts").alias("last_ts")]
    for name, days in offsets.items():
        seen = F.col("ts") <= F.date_sub("__ref", days)
        aggs.append(F.max_by("close", F.when(seen, F.col("ts"))).alias(name))
    return rows.groupBy("symbol").agg(*aggs)
