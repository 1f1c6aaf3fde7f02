"""Named constants that define the semantics of the statistics, score and strategies."""

from __future__ import annotations

import datetime as dt

# Fixed values (must equal the published definitions of the statistics).
VALUATION_MIN_1Y = 180
VALUATION_MIN_3Y = 400
BASING_MIN = 180
RANGE_MIN = 30
SMA_MIN = 60
YEAR = 365
THREE_YEARS = 1095
QUARTER = 90
SMA_WINDOW = 200

BOUNCE_TOUCH_PCT = 15.0
BOUNCE_RALLY_PCT = 30.0
BOUNCE_LOOKBACK = 120
BOUNCE_PEAK_SPAN = 30
BOUNCE_SEPARATION = 45

SCORE_MIN_CAP = 10_000_000.0
SCORE_MIN_VOLUME = 250_000.0
SCORE_WEIGHTS = {
    "valuation": 0.27,
    "distance": 0.22,
    "median_gap": 0.14,
    "basing": 0.13,
    "range": 0.14,
    "dip_respect": 0.10,
}
KNIFE_PENALTY = -10.0
KNIFE_TREND_30D = -40.0
KNIFE_TREND_90D = -60.0

FREQUENCY_DAYS = {"weekly": 7, "monthly": 30, "quarterly": 91}
WARMUP_CANDLES = 400
REGIME_SMA_ANCHORS = 6

MIN_TRACKED_CAP = 10_000_000.0
PRICE_TOLERANCE_PCT = 5.0
BACKFILL_TOLERANCE_DAYS = 2
GAP_DAYS = 3
MIN_UNIVERSE = 30
DEFAULT_EVENT_CUTOFF = dt.date(2021, 1, 1)

# The 26 ranked features of the learned score with their orientation
# (+1: larger is better, -1: smaller is better).
FEATURE_DIRECTIONS = {
    "valuation_pct_1y": -1,
    "valuation_pct_3y": -1,
    "valuation_pct_all": -1,
    "distance": -1,
    "abs_median_dist_3y": -1,
    "basing_pct_90d": 1,
    "range_position": -1,
    "trend_7d": 1,
    "trend_90d": 1,
    "trend_180d": 1,
    "trend_365d": 1,
    "volatility_90d": -1,
    "drawdown_from_ath": -1,
    "days_since_ath": 1,
    "dollar_volume_30d": 1,
    "band_p05_dist_3y": -1,
    "band_p25_dist_3y": -1,
    "band_p75_dist_3y": -1,
    "band_p95_dist_3y": -1,
    "band_iqr_width_3y": -1,
    "band_span_width_3y": -1,
    "above_p75_3y": -1,
    "below_p25_3y": 1,
    "top_band_share_90d": -1,
    "dip_bounces": 1,
    "dip_bounce_avg": 1,
}
