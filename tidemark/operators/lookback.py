"""History statistics per (symbol, anchor).

One shuffle by symbol carries everything: row-level windows, then the series as one array
beside the rows that are the latest candle of some anchor. Each anchor's statistics are read
from slices of that array. A series has one candle per day, so the array length is bounded by
the calendar, not by the data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.numeric import distance_pct, pct_change, round1
from tidemark.functions.quantiles import count_le, lower_quarter, median, nearest_lower
from tidemark.operators.calendar import Calendar

STATS = [
    "valuation_pct_1y", "valuation_pct_3y", "valuation_pct_all", "median_dist_1y", "median_dist_3y",
    "range_position", "days_since_atl", "basing_pct_90d", "trend_7d", "trend_30d", "trend_90d", "trend_180d",
    "trend_365d", "above_sma200", "history_days", "band_p05_dist_3y", "band_p25_dist_3y", "band_p75_dist_3y",
    "band_p95_dist_3y", "band_iqr_width_3y", "band_span_width_3y", "above_p75_3y", "below_p25_3y",
    "top_band_share_90d", "dip_touches", "dip_bounces", "dip_bounce_avg",
]
EXTRAS = ["volatility_30d", "volatility_90d", "drawdown_from_ath", "days_since_ath", "dollar_volume_30d"]
TREND_LAGS = {"trend_7d": 7, "trend_30d": 30, "trend_90d": 90, "trend_180d": 180, "trend_365d": 365}
TOUCH = 1.0 + P.BOUNCE_TOUCH_PCT / 100.0


def row_windows(candles: DataFrame, event_start: dt.date) -> DataFrame:
    """Lagged and running columns of every candle (one window sort per symbol)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    close, low = F.col("close"), F.col("low")
    base = candles.select("symbol", "ts", "close", "low", "volume").select(
        "*",
        F.row_number().over(w).alias("rn"),
        F.lead("ts").over(w).alias("next_ts"),
        *[F.lag("close", k).over(w).alias(f"lag_{k}") for k in TREND_LAGS.values()],
    )
    return base.select(
        "*",
        F.avg(F.coalesce(F.col("volume"), F.lit(0.0)) * close).over(w.rowsBetween(-29, 0)).alias("dollar_volume_30d"),
        F.min("close").over(whole).alias("min_close"),
        F.max("close").over(whole).alias("max_close"),
        F.min("low").over(whole).alias("atl"),
        F.min(F.struct("low", "rn")).over(whole)["rn"].alias("atl_rn"),
        F.max(F.struct("close", "rn")).over(whole)["rn"].alias("ath_rn"),
        F.min(F.when(F.col("ts") >= F.lit(event_start), low)).over(whole).alias("event_low_raw"),
        F.max("close").over(w.rowsBetween(-P.BOUNCE_PEAK_SPAN, 0)).alias("peak_close"),
    )


def _peaks(tops: Column, closes: Column) -> Column:
    """Local maxima that can ever be an accepted peak, with their trough.

    ``tops`` are the rows equal to their trailing maximum. The trough is the earliest minimum of
    the full lookback; a lookback cut short by an anchor's window only raises it, so keeping the
    rows with a sufficient full-lookback rally loses no accepted peak. ``blocker`` is the last row
    up to the trough that already lay too far below it: the trough is a dip exactly when no such
    row falls inside the anchor's window.
    """
    first = lambda p: F.greatest(p["rn"] - P.BOUNCE_LOOKBACK, F.lit(1))
    looked = F.transform(
        tops,
        lambda p: F.struct(
            p["rn"].alias("rn"),
            p["close"].alias("close"),
            p["run_low"].alias("run_low"),
            F.slice(closes, first(p), p["rn"] - first(p) + 1).alias("seen"),
        ),
    )
    troughs = F.transform(
        looked,
        lambda p: F.struct(
            p["rn"].alias("rn"),
            p["close"].alias("close"),
            p["run_low"].alias("run_low"),
            F.array_min(p["seen"]).alias("trough"),
            (first(p) - 1 + F.array_position(p["seen"], F.array_min(p["seen"]))).cast("int").alias("trough_rn"),
        ),
    )
    rally = P.BOUNCE_RALLY_PCT / 100.0
    rallied = F.filter(troughs, lambda p: (p["trough"] > 0) & (p["close"] / p["trough"] - 1.0 >= rally))
    return F.transform(
        rallied,
        lambda p: F.struct(
            p["rn"].alias("rn"),
            p["close"].alias("close"),
            p["run_low"].alias("run_low"),
            (p["close"] / p["trough"] - 1.0).alias("gain"),
            F.coalesce(
                F.array_max(
                    F.transform(
                        F.slice(closes, F.lit(1), p["trough_rn"]),
                        lambda c, j: F.when(p["trough"] > c * TOUCH, j + 1),
                    )
                ),
                F.lit(0),
            ).alias("blocker"),
        ),
    )


def _eligible(peaks: Column) -> Column:
    """(rn, gain) of the peaks that pass the dip test inside the anchor's window.

    Uses the columns first_row, scan_from, full_from, rn and head of the anchor row.
    """
    first_row, scan_from, full_from = F.col("first_row"), F.col("scan_from"), F.col("full_from")
    inside = F.filter(
        peaks,
        lambda p: (p["rn"] >= scan_from)
        & (p["rn"] <= F.col("rn"))
        & ((p["rn"] < full_from) | (p["blocker"] < first_row)),
    )
    cut_low = lambda p: F.when(F.col("head").isNull(), p["run_low"]).otherwise(
        F.array_min(F.slice("head", F.lit(1), p["rn"] - first_row + 1))
    )
    gains = F.transform(
        inside,
        lambda p: F.struct(
            p["rn"].alias("rn"),
            F.when(p["rn"] < full_from, p["close"] / cut_low(p) - 1.0).otherwise(p["gain"]).alias("gain"),
        ),
    )
    return F.filter(gains, lambda p: p["gain"] >= P.BOUNCE_RALLY_PCT / 100.0)


def _separated(eligible: Column) -> Column:
    """Greedy scan: accept a peak, then skip the separation span. (count, gain sum, next row)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("gain"), F.lit(0).alias("next"))
    return F.aggregate(
        eligible,
        zero,
        lambda acc, p: F.when(p["rn"] < acc["next"], acc).otherwise(
            F.struct(
                (acc["n"] + 1).alias("n"),
                (acc["gain"] + p["gain"]).alias("gain"),
                (p["rn"] + P.BOUNCE_SEPARATION).alias("next"),
            )
        ),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _sample_std(values: Column, mean: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.sqrt(squares / (F.size(values) - 1))


ROW_COLUMNS = [
    "rn", "ts", "close", "atl", "atl_rn", "ath_rn", "event_low_raw", "min_close", "max_close",
    "dollar_volume_30d",
]


def lookback_stats(
    candles: DataFrame, calendar: Calendar, event_start: dt.date = P.DEFAULT_EVENT_CUTOFF, min_candles: int = 1
) -> DataFrame:
    """All history statistics for each (symbol, anchor) with at least ``min_candles`` candles.

    Adds price, lows and distances, the 27 statistics and the five trailing extras. Only
    candles at or before the anchor are ever visible to it.
    """
    # Several tasks per core: the work per row is far heavier than its bytes suggest.
    spark = candles.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    seen = (
        candles.filter((F.col("ts") <= F.lit(calendar.end)) & F.col("close").isNotNull())
        # Never null, and typed so: arrays of it sort as primitives.
        .select("symbol", "ts", F.coalesce("close", F.lit(0.0)).alias("close"), "low", "volume")
        .repartition(parts, "symbol")
    )
    rows = row_windows(seen, event_start).withColumn("cover", calendar.covered_by(F.col("ts"), F.col("next_ts")))
    kept = [*ROW_COLUMNS, *[f"lag_{k}" for k in TREND_LAGS.values()]]
    wanted = F.col("cover").isNotNull() & (F.col("rn") >= min_candles)
    top = F.when(
        F.col("close") >= F.col("peak_close"), F.struct("rn", "close", F.col("min_close").alias("run_low"))
    )
    series = (
        rows.groupBy("symbol")
        .agg(
            F.sort_array(F.collect_list(F.struct("rn", "close")))["close"].alias("close_array"),
            F.sort_array(F.collect_list(top)).alias("tops"),
            F.collect_list(F.when(wanted, F.struct("cover", *kept))).alias("points"),
        )
        .filter(F.size("points") > 0)
        .withColumn("peaks", _peaks(F.col("tops"), F.col("close_array")))
    )
    per_anchor = F.flatten(
        F.transform(
            "points",
            lambda p: F.transform(p["cover"], lambda a: F.struct(a.alias("anchor"), *[p[c].alias(c) for c in kept])),
        )
    )
    points = series.select("symbol", "close_array", "peaks", F.explode(per_anchor).alias("p")).select(
        "symbol", "close_array", "peaks", "p.*"
    )
    return _finish(points)


def _log_returns(closes: Column) -> Column:
    """Log returns between neighbours of an array, where both are positive."""
    n = F.size(closes) - 1
    pairs = F.zip_with(
        F.slice(closes, F.lit(1), n), F.slice(closes, F.lit(2), n), lambda a, b: F.when((a > 0) & (b > 0), F.log(b / a))
    )
    return F.filter(pairs, lambda r: r.isNotNull())


def _tail(array: str, n: int) -> Column:
    """The last n entries up to the anchor's row."""
    rn = F.col("rn")
    return F.slice(array, F.greatest(rn - (n - 1), F.lit(1)), F.least(rn, F.lit(n)))


def _finish(points: DataFrame) -> DataFrame:
    rn, close = F.col("rn"), F.col("close")
    has_1y, has_3y = rn >= P.VALUATION_MIN_1Y, rn >= P.VALUATION_MIN_3Y
    first_row = F.greatest(rn - (P.THREE_YEARS - 1), F.lit(1))
    past_3y = rn > P.THREE_YEARS
    windows = points.withColumns(
        {
            "s1": F.when(has_1y, F.sort_array(_tail("close_array", P.YEAR))),
            "s3": F.when(
                rn >= P.BOUNCE_LOOKBACK + P.BOUNCE_PEAK_SPAN, F.sort_array(_tail("close_array", P.THREE_YEARS))
            ),
            "last90": _tail("close_array", P.QUARTER),
            "last200": F.when(rn >= P.SMA_MIN, _tail("close_array", P.SMA_WINDOW)),
            "last31": _tail("close_array", 31),
            "last91": _tail("close_array", 91),
            "head": F.when(past_3y, F.slice("close_array", first_row, P.BOUNCE_LOOKBACK + 1)),
            "older": F.when(past_3y, F.slice("close_array", F.lit(1), rn - P.THREE_YEARS)),
            "first_row": first_row,
            "scan_from": first_row + P.BOUNCE_PEAK_SPAN,
            "full_from": first_row + P.BOUNCE_LOOKBACK,
        }
    )
    windows = windows.withColumns({"ret30": _log_returns(F.col("last31")), "ret90": _log_returns(F.col("last91"))})
    counted = windows.withColumns(
        {
            "n1": F.size("s1"),
            "n3": F.size("s3"),
            "le1": count_le(F.col("s1"), close),
            "le3": F.when(F.col("s3").isNotNull(), count_le(F.col("s3"), close)),
            "le_old": F.when(
                F.col("older").isNotNull(), F.size(F.filter("older", lambda x: x <= close))
            ).otherwise(F.lit(0)),
            "med1": median(F.col("s1")),
            "med3": F.when(has_3y, median(F.col("s3"))),
            "p25_1y": F.when(has_1y, lower_quarter(F.col("s1"))),
            **{
                f"p{int(q * 100):02d}": F.when(has_3y, nearest_lower(F.col("s3"), q))
                for q in (0.05, 0.25, 0.5, 0.75, 0.95)
            },
            "sma200": F.when(F.col("last200").isNotNull(), _sum(F.col("last200")) / F.size("last200")),
            "mean30": F.when(F.size("ret30") >= 10, _sum(F.col("ret30")) / F.size("ret30")),
            "mean90": F.when(F.size("ret90") >= 30, _sum(F.col("ret90")) / F.size("ret90")),
            "bounce": F.when(F.col("s3").isNotNull(), _separated(_eligible(F.col("peaks")))),
            "low3": F.element_at("s3", 1),
        }
    )
    raw = counted.select(
        "symbol",
        "anchor",
        F.col("ts").alias("last_ts"),
        close.alias("price"),
        "atl",
        F.coalesce("event_low_raw", "atl").alias("event_low"),
        F.when(has_1y, 100.0 * F.col("le1") / F.col("n1")).alias("valuation_pct_1y"),
        F.when(has_3y, 100.0 * F.col("le3") / F.col("n3")).alias("valuation_pct_3y"),
        F.when(has_1y, 100.0 * (F.col("le3") + F.col("le_old")) / rn).alias("valuation_pct_all"),
        F.when(F.col("med1") != 0, (close - F.col("med1")) / F.col("med1") * 100).alias("median_dist_1y"),
        F.when(F.col("med3") != 0, (close - F.col("med3")) / F.col("med3") * 100).alias("median_dist_3y"),
        F.when(
            (rn >= P.RANGE_MIN) & (F.col("max_close") > F.col("min_close")),
            F.round((close - F.col("min_close")) / (F.col("max_close") - F.col("min_close")), 3),
        ).alias("range_position"),
        F.when(rn >= P.RANGE_MIN, rn - F.col("atl_rn")).alias("days_since_atl"),
        F.when(
            rn >= P.BASING_MIN,
            100.0 * F.size(F.filter("last90", lambda x: x <= F.col("p25_1y"))) / F.size("last90"),
        ).alias("basing_pct_90d"),
        *[pct_change(close, F.col(f"lag_{k}")).alias(name) for name, k in TREND_LAGS.items()],
        F.when(rn >= P.SMA_MIN, close > F.col("sma200")).alias("above_sma200"),
        rn.alias("history_days"),
        *[
            F.when(F.col(p) != 0, (close - F.col(p)) / F.col(p) * 100).alias(f"band_{p}_dist_3y")
            for p in ("p05", "p25", "p75", "p95")
        ],
        F.when(F.col("p50") != 0, F.round((F.col("p75") - F.col("p25")) / F.col("p50"), 3)).alias("band_iqr_width_3y"),
        F.when(F.col("p50") != 0, F.round((F.col("p95") - F.col("p05")) / F.col("p50"), 3)).alias("band_span_width_3y"),
        F.when(F.col("p75") != 0, (close > F.col("p75")).cast("int")).alias("above_p75_3y"),
        F.when(F.col("p25") != 0, (close < F.col("p25")).cast("int")).alias("below_p25_3y"),
        F.when(
            F.col("p75") != 0, 100.0 * F.size(F.filter("last90", lambda x: x >= F.col("p75"))) / F.size("last90")
        ).alias("top_band_share_90d"),
        F.coalesce(F.col("bounce.n") + (close <= F.col("low3") * TOUCH).cast("int"), F.lit(0)).alias("dip_touches"),
        F.coalesce(F.col("bounce.n"), F.lit(0)).alias("dip_bounces"),
        F.when(F.col("bounce.n") > 0, 100.0 * F.col("bounce.gain") / F.col("bounce.n")).alias("dip_bounce_avg"),
        F.when(F.col("mean30").isNotNull(), _sample_std(F.col("ret30"), F.col("mean30"))).alias("volatility_30d"),
        F.when(F.col("mean90").isNotNull(), _sample_std(F.col("ret90"), F.col("mean90"))).alias("volatility_90d"),
        F.when(F.col("max_close") != 0, close / F.col("max_close") - 1.0).alias("drawdown_from_ath"),
        (rn - F.col("ath_rn")).alias("days_since_ath"),
        "dollar_volume_30d",
    )
    one_decimal = [
        "valuation_pct_1y", "valuation_pct_3y", "valuation_pct_all", "median_dist_1y", "median_dist_3y",
        "basing_pct_90d", *TREND_LAGS, "band_p05_dist_3y", "band_p25_dist_3y", "band_p75_dist_3y",
        "band_p95_dist_3y", "top_band_share_90d", "dip_bounce_avg",
    ]
    return raw.withColumns({c: round1(F.col(c)) for c in one_decimal}).withColumns(
        {
            "distance": distance_pct(F.col("price"), F.col("event_low")),
            "distance_atl": distance_pct(F.col("price"), F.col("atl")),
        }
    )
