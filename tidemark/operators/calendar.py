"""Rebalance anchors and the as-of cover.

A candle (or archive row) is the latest one for every anchor from its own day up to the day
before the next row. Generating those anchors per row turns an as-of join into a projection:
no range join, no shuffle beyond the one that orders the series.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.params import FREQUENCY_DAYS, REGIME_SMA_ANCHORS, WARMUP_CANDLES

MONTH_STEPS = {"monthly": 1, "quarterly": 3}


def _add_months(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def regime_warmup_start(start: dt.date, frequency: str) -> dt.date:
    """Earliest anchor a window needs so that the regime average is defined at its start."""
    return start - dt.timedelta(days=(REGIME_SMA_ANCHORS + 2) * FREQUENCY_DAYS[frequency])


@dataclass(frozen=True)
class Calendar:
    """Anchors ``first, first + step, ...`` up to ``end``; frequency ``once`` is a single day."""

    frequency: str
    first: dt.date
    end: dt.date

    @classmethod
    def between(cls, frequency: str, start: dt.date, end: dt.date) -> Calendar:
        if frequency == "once":
            return cls(frequency, end, end)
        if frequency == "weekly":
            return cls(frequency, start + dt.timedelta(days=(7 - start.weekday()) % 7), end)
        if frequency not in MONTH_STEPS:
            raise ValueError("frequency must be weekly, monthly or quarterly")
        if start.day == 1:
            return cls(frequency, start, end)
        # The cursor starts at the first of the start month, so the phase follows the start.
        return cls(frequency, _add_months(start, MONTH_STEPS[frequency]), end)

    @classmethod
    def for_history(
        cls, frequency: str, first_candle: dt.date, end: dt.date, earliest: dt.date | None = None
    ) -> Calendar:
        """Anchors of a panel: after the warm-up of the oldest series, or from ``earliest`` if later."""
        start = first_candle + dt.timedelta(days=WARMUP_CANDLES)
        if earliest is not None:
            start = max(start, earliest)
        return cls.between(frequency, start, end)

    @classmethod
    def once(cls, day: dt.date) -> Calendar:
        return cls("once", day, day)

    def covered_by(self, ts: Column, next_ts: Column) -> Column:
        """Array of the anchors in [ts, next_ts), null when there is none."""
        first, end = F.lit(self.first), F.lit(self.end)
        last = F.least(F.coalesce(F.date_sub(next_ts, 1), end), end)
        if self.frequency == "once":
            return F.when((ts <= first) & (last >= first), F.array(first))
        start = F.greatest(ts, first)
        if self.frequency == "weekly":
            begin = F.date_add(first, (F.ceil(F.datediff(start, first) / 7) * 7).cast("int"))
            step = F.expr("interval 7 days")
        else:
            months = MONTH_STEPS[self.frequency]
            gap = (F.year(start) - self.first.year) * 12 + F.month(start) - self.first.month
            gap = gap + F.when(F.dayofmonth(start) > 1, 1).otherwise(0)
            begin = F.add_months(first, (F.ceil(gap / months) * months).cast("int"))
            step = F.expr(f"interval {months} months")
        return F.when(begin <= last, F.sequence(begin, last, step))

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per anchor with its index and the next anchor."""
        days = self.covered_by(F.lit(self.first), F.lit(None).cast("date"))
        one = spark.range(1).select(F.posexplode(days).alias("idx", "anchor"))
        w = Window.partitionBy(F.lit(self.frequency)).orderBy("anchor")
        return one.select(
            F.lit(self.frequency).alias("frequency"),
            F.col("anchor"),
            F.col("idx").cast("int").alias("idx"),
            F.lead("anchor").over(w).alias("next_anchor"),
        )


def history_bounds(candles: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last day of the history: one aggregated row."""
    row = candles.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return row["a"], row["b"]


def cover_anchors(rows: DataFrame, calendar: Calendar, keys: list[str], ts: str = "ts") -> DataFrame:
    """As-of: for every key and anchor the last row at or before the anchor, plus ``anchor``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    nxt = F.lead(ts).over(w)
    return (
        rows.withColumn("__next", nxt)
        .withColumn("__cover", calendar.covered_by(F.col(ts), F.col("__next")))
        .filter(F.col("__cover").isNotNull())
        .withColumn("anchor", F.explode("__cover"))
        .drop("__cover", "__next")
    )
