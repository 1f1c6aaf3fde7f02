"""Series, board, quality and top-k queries (sections C, D, E, F and H)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from catalog.core import spec
from catalog.registry import EVENT, REGISTRY, query
from catalog.sqlbase import CTES, r1, score_chain
from tidemark.functions import symbols as S
from tidemark.functions.ranks import rank_percentiles
from tidemark.operators import asof as A
from tidemark.operators import board as B
from tidemark.operators import quality as Q
from tidemark.operators import series as R
from tidemark.operators.calendar import Calendar, cover_anchors
from tidemark.operators.lookback import EXTRAS, STATS, lookback_stats
from tidemark.operators.score import eligible, with_components
from tidemark.session import materialize, shared_dir
from tidemark.sources import sinks


DAY = dt.date(2000, 6, 30)
CUT = dt.date(1995, 1, 5)

CTES["prices_back"] = """
SELECT symbol, max_by(close, ts) FILTER (ts <= DATE '2000-06-30' - 7) AS price_7d,
  max_by(close, ts) FILTER (ts <= DATE '2000-06-30' - 30) AS price_30d FROM candles GROUP BY 1"""
CTES["board_rows"] = """
SELECT s.*, c.name, c.market_id, c.listing_date, c.is_pre_cutoff, c.is_stable, c.market_cap, c.volume_24h,
  p.price_7d, p.price_30d, c.symbol AS base_asset
FROM stats_o s JOIN coins c USING (symbol) LEFT JOIN prices_back p USING (symbol) WHERE c.delisted_at IS NULL"""
_gate = "NOT is_stable AND valuation_pct_3y IS NOT NULL AND market_cap >= 10000000 AND volume_24h >= 250000"
CTES.update(score_chain("board_rows", "board", _gate))
CTES["board"] = """
SELECT b.*, s.score AS value_score, s.part_valuation, s.part_distance, s.part_median_gap, s.part_basing, s.part_range,
  s.part_dip_respect, s.knife,
  round(CASE WHEN market_cap > 0 THEN 10 + sqrt(market_cap) / sqrt(max(market_cap) OVER ()) * 90 ELSE 10 END, 2) AS bubble_size,
  round(price * (SELECT max_by(close, ts) FROM rates WHERE ts <= DATE '2000-06-30'), 10) AS price_usd
FROM board_rows b LEFT JOIN board_scored s USING (symbol)"""


def board(ws):
    return ws.keep("board", lambda: B.board_as_of(ws.candles, ws.coins, ws.rates, DAY, EVENT))


def stats_at(ws):
    return ws.keep("stats_at", lambda: materialize(lookback_stats(ws.candles, Calendar.once(DAY), EVENT), "stats"))


# --- E: statistics as of one day, and every-row series ----------------------------------------
for _key, _names in {
    "valuation_percentiles": ["valuation_pct_1y", "valuation_pct_3y", "valuation_pct_all"],
    "median_distance": ["median_dist_1y", "median_dist_3y"],
    "band_stats": [
        "band_p05_dist_3y", "band_p25_dist_3y", "band_p75_dist_3y", "band_p95_dist_3y", "band_iqr_width_3y",
        "band_span_width_3y", "above_p75_3y", "below_p25_3y",
    ],
    "top_band_share_90d": ["top_band_share_90d"],
    "range_position": ["range_position"],
    "days_since_atl": ["days_since_atl"],
    "basing_pct_90d": ["basing_pct_90d"],
    "dip_respect": ["dip_touches", "dip_bounces", "dip_bounce_avg"],
    "drawdown_from_ath": ["drawdown_from_ath", "days_since_ath"],
    "coin_stats": [*STATS, *EXTRAS],
}.items():
    query(_key, f"symbol:s {spec(*_names)}", "SELECT * FROM stats_o")(lambda ws: stats_at(ws))

_TRAIL = """
SELECT symbol, ts, rn,
  (close / lag(close, 7) OVER w - 1.0) * 100.0 AS trend_7d, (close / lag(close, 30) OVER w - 1.0) * 100.0 AS trend_30d,
  (close / lag(close, 90) OVER w - 1.0) * 100.0 AS trend_90d, (close / lag(close, 180) OVER w - 1.0) * 100.0 AS trend_180d,
  (close / lag(close, 365) OVER w - 1.0) * 100.0 AS trend_365d,
  CASE WHEN rn >= 60 THEN close > avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 199 PRECEDING) END AS above_sma200,
  CASE WHEN count(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) >= 10
    THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) END AS volatility_30d,
  CASE WHEN count(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS 89 PRECEDING) >= 30
    THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS 89 PRECEDING) END AS volatility_90d,
  avg(volume * close) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS dollar_volume_30d
FROM crn JOIN rets USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""


def trailing(ws):
    return ws.keep("trailing", lambda: R.trailing_stats(ws.candles))


query("trends", "symbol:s ts:d trend_7d:f5 trend_30d:f5 trend_90d:f5 trend_180d:f5 trend_365d:f5", _TRAIL)(trailing)
query("above_sma200", "symbol:s ts:d above_sma200:b", _TRAIL)(trailing)
query("realized_volatility", "symbol:s ts:d volatility_30d:f6 volatility_90d:f6", _TRAIL)(trailing)
query("dollar_volume_30d", "symbol:s ts:d dollar_volume_30d:f5", _TRAIL)(trailing)

_EXTREMA = """
SELECT symbol, ts, rn, min(low) OVER w AS atl, arg_min(rn, row(low, rn)) OVER w AS atl_rn, min(close) OVER w AS min_close,
  max(close) OVER w AS max_close, arg_max(rn, row(close, rn)) OVER w AS ath_rn,
  coalesce(min(low) FILTER (ts >= DATE '1998-01-01') OVER w, min(low) OVER w) AS event_low
FROM crn WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
query(
    "running_extrema", "symbol:s ts:d rn:i atl:f8 atl_rn:i min_close:f8 max_close:f8 ath_rn:i event_low:f8", _EXTREMA
)(lambda ws: R.running_extrema(ws.candles, EVENT))

CTES["dip"] = f"""
SELECT c.symbol, c.ts, c.close, e.atl AS all_time_low, e.event_low,
  (c.close - e.event_low) / e.event_low * 100.0 AS distance_event, (c.close - e.atl) / e.atl * 100.0 AS distance_atl
FROM crn c JOIN ({_EXTREMA}) e USING (symbol, ts)"""
DIP_SPEC = "symbol:s ts:d close:f8 all_time_low:f8 event_low:f8 distance_event:f5 distance_atl:f5"
query("dip_history", DIP_SPEC, "SELECT * FROM dip")(lambda ws: R.dip_history(ws.candles, EVENT))
query(
    "dip_history_latest",
    DIP_SPEC,
    "SELECT * FROM dip QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 365",
)(lambda ws: R.dip_history(ws.candles, EVENT, 365))

query(
    "dip_zone_visits",
    "symbol:s ts:d peak:f5",
    """WITH RECURSIVE f AS (
      SELECT symbol, ts, row_number() OVER w - 1 AS i, distance_event AS d,
        max(distance_event) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 179 FOLLOWING) AS peak
      FROM dip WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    z AS (SELECT a.symbol, a.ts, a.i, a.peak, coalesce(min(b.i), max(m.n)) AS ex FROM f a
          JOIN (SELECT symbol, count(*) AS n FROM f GROUP BY 1) m USING (symbol)
          LEFT JOIN f b ON b.symbol = a.symbol AND b.i > a.i AND b.d > 15 WHERE a.d <= 15 GROUP BY 1, 2, 3, 4),
    v AS (SELECT symbol, min(i) AS i FROM z GROUP BY 1
          UNION ALL
          SELECT v.symbol, (SELECT min(n.i) FROM z n WHERE n.symbol = v.symbol AND n.i >= greatest(z.ex, v.i + 45))
          FROM v JOIN z ON z.symbol = v.symbol AND z.i = v.i WHERE v.i IS NOT NULL)
    SELECT z.symbol, z.ts, z.peak FROM v JOIN z ON z.symbol = v.symbol AND z.i = v.i WHERE z.peak >= 30""",
)(lambda ws: R.zone_visits(R.dip_history(ws.candles, EVENT)))

query(
    "relative_performance",
    "symbol:s ts:d value:f8",
    """SELECT symbol, ts, close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS value FROM (
      SELECT * FROM candles WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3')
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 365)""",
)(lambda ws: R.relative_performance(ws.candles, ["Brand#1", "Brand#2", "Brand#3"], 365))

_LATEST = "SELECT symbol, max(ts) AS ts, max_by(close, ts) AS close FROM candles WHERE ts <= DATE '2000-06-30' GROUP BY 1"
query("latest_row", "symbol:s ts:d close:f8", _LATEST)(lambda ws: R.latest(ws.candles, DAY))
query("asof_candle", "symbol:s ts:d close:f8", _LATEST)(lambda ws: R.latest(ws.candles, DAY))
query(
    "latest_ts", "symbol:s ts:d close:f8", "SELECT symbol, max(ts) AS ts, max_by(close, ts) AS close FROM candles GROUP BY 1"
)(lambda ws: R.latest(ws.candles))
query(
    "asof_candle_anchors",
    "symbol:s anchor:d ts:d close:f8",
    "SELECT c.symbol, a.anchor, max(c.ts) AS ts, max_by(c.close, c.ts) AS close FROM candles c JOIN anchors_m a ON c.ts <= a.anchor GROUP BY 1, 2",
)(lambda ws: cover_anchors(ws.candles.select("symbol", "ts", "close"), ws.calendar("monthly"), ["symbol"]))
query(
    "latest_n_ascending",
    "symbol:s ts:d close:f8 volume:f6",
    "SELECT * FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 365",
)(lambda ws: R.latest_n(ws.candles, 365).orderBy("symbol", "ts"))

# --- C: as-of joins ----------------------------------------------------------------------------
query(
    "asof_market",
    "symbol:s anchor:d cap:f4 volume:f4",
    """SELECT p.symbol, a.anchor, coalesce(m.r[1], c.market_cap) AS cap, coalesce(m.r[2], c.volume_24h) AS volume
    FROM anchors_m a CROSS JOIN coins p JOIN coins c ON c.symbol = p.symbol
    LEFT JOIN mkt_m m ON m.symbol = p.symbol AND m.anchor = a.anchor""",
)(
    lambda ws: A.asof_market(
        cover_anchors(ws.coins.select("symbol", "listing_date"), ws.calendar("monthly"), ["symbol"], "listing_date"),
        ws.market_history,
        ws.coins,
        ws.calendar("monthly"),
    )
)


def _high_rates(ws):
    """The day's high as the rate."""
    return ws.rates.withColumn("close", F.col("high"))


CTES["high_rates"] = "SELECT ts, high, low, high AS close FROM rates"
CTES["rate_days"] = "SELECT d.ts, r.close AS rate FROM (SELECT DISTINCT ts FROM candles) d ASOF LEFT JOIN high_rates r ON d.ts >= r.ts"
query("asof_rate_strict", "ts:d rate:f6", "SELECT * FROM rate_days")(
    lambda ws: A.asof_rate(ws.candles.select("ts").distinct(), _high_rates(ws))
)
query(
    "asof_rate_clamp",
    "ts:d rate:f6",
    "SELECT ts, coalesce(rate, (SELECT min_by(close, ts) FROM high_rates)) AS rate FROM rate_days",
)(lambda ws: A.asof_rate(ws.candles.select("ts").distinct(), _high_rates(ws), policy="clamp"))
query(
    "history_usd",
    "symbol:s ts:d open:f4 high:f4 low:f4 close:f4 volume:f4",
    """SELECT symbol, ts, open * rate AS open, high * rate AS high, low * rate AS low, close * rate AS close, volume * rate AS volume
    FROM candles JOIN rate_days USING (ts) WHERE rate IS NOT NULL""",
)(lambda ws: A.history_in_quote(ws.candles, _high_rates(ws)))
query(
    "lagged_prices",
    "symbol:s price:f8 last_ts:d price_7d:f8 price_30d:f8",
    """SELECT symbol, max_by(close, ts) AS price, max(ts) AS last_ts, max_by(close, ts) FILTER (ts <= m - 7) AS price_7d,
      max_by(close, ts) FILTER (ts <= m - 30) AS price_30d
    FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS m FROM candles) GROUP BY 1""",
)(lambda ws: A.close_before(ws.candles, {"price_7d": 7, "price_30d": 30}))
query(
    "lagged_prices_as_of",
    "symbol:s price_7d:f8 price_30d:f8",
    "SELECT * FROM prices_back",
)(lambda ws: A.close_before(ws.candles, {"price_7d": 7, "price_30d": 30}, DAY))
query(
    "custom_low",
    "symbol:s event_low:f8 distance:f5",
    """SELECT symbol, coalesce(l, 1.0) AS event_low, (current_price - coalesce(l, 1.0)) / coalesce(l, 1.0) * 100.0 AS distance
    FROM coins LEFT JOIN (SELECT symbol, min(low) AS l FROM candles WHERE ts >= DATE '2001-11-01' GROUP BY 1) USING (symbol)""",
)(lambda ws: R.custom_low(ws.coins.withColumn("event_low", F.lit(1.0)), ws.candles, dt.date(2001, 11, 1)))
query(
    "watchlist_board",
    "symbol:s threshold_pct:f2 price:f8 distance:f5 distance_atl:f5 market_cap:f2 created_at:d",
    """SELECT w.symbol, w.threshold_pct, b.price, b.distance, b.distance_atl, b.market_cap, w.created_at
    FROM watchlist w LEFT JOIN board b USING (symbol)""",
)(lambda ws: B.watchlist_board(ws.watchlist, board(ws)).orderBy(F.desc("created_at"), "symbol"))

# --- D: aggregations ---------------------------------------------------------------------------
_LOWS = """SELECT symbol, min(low) AS atl, coalesce(min(low) FILTER (ts >= DATE '2000-06-25'), min(low)) AS event_low
FROM candles WHERE ts <= DATE '2000-06-30' GROUP BY 1"""
query("atl_by_symbol", "symbol:s atl:f8", _LOWS)(lambda ws: R.lows(ws.candles, dt.date(2000, 6, 25), DAY))
query("event_low_by_symbol", "symbol:s event_low:f8", _LOWS)(lambda ws: R.lows(ws.candles, dt.date(2000, 6, 25), DAY))
query(
    "universe_counts",
    "total:i active:i delisted:i stable:i with_id:i",
    """SELECT count(*) AS total, count(*) FILTER (delisted_at IS NULL) AS active, count(delisted_at) AS delisted,
      count(*) FILTER (is_stable) AS stable, count(market_id) AS with_id FROM coins""",
)(lambda ws: Q.universe_counts(ws.coins))
query(
    "candle_coverage",
    "symbols:i rows:i median_candles:i p10_candles:i symbols_ge_400:i symbols_ge_1095:i",
    """SELECT count(*) AS symbols, sum(n) AS rows,
      list_sort(list(n))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS INTEGER) + 1] AS median_candles,
      list_sort(list(n))[CAST(least(count(*) - 1, floor(0.1 * count(*))) AS INTEGER) + 1] AS p10_candles,
      count(*) FILTER (n >= 400) AS symbols_ge_400, count(*) FILTER (n >= 1095) AS symbols_ge_1095
    FROM (SELECT symbol, count(*) AS n FROM candles GROUP BY 1)""",
)(lambda ws: Q.candle_coverage(ws.candles))
_GAPS = """SELECT count(DISTINCT symbol) AS symbols_with_gaps, count(*) AS total_gaps FROM (
  SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM {0}) WHERE g > 3"""
query("candle_gaps", "symbols_with_gaps:i total_gaps:i", _GAPS.format("candles"))(lambda ws: Q.candle_gaps(ws.candles))
query(
    "market_history_gaps",
    "symbols:i rows:i symbols_ge_400:i first_day:d last_day:d coverage:f3 symbols_with_gaps:i total_gaps:i",
    f"""SELECT (SELECT count(DISTINCT symbol) FROM market_history) AS symbols, (SELECT count(*) FROM market_history) AS rows,
      (SELECT count(*) FROM (SELECT symbol FROM market_history GROUP BY 1 HAVING count(*) >= 400)) AS symbols_ge_400,
      (SELECT min(ts) FROM market_history) AS first_day, (SELECT max(ts) FROM market_history) AS last_day,
      round((SELECT count(DISTINCT symbol) FROM market_history) / (SELECT count(market_id) FROM coins), 3) AS coverage,
      g.* FROM ({_GAPS.format("market_history")}) g""",
)(lambda ws: Q.market_history_report(ws.market_history, ws.coins))
query(
    "liquidity_staleness",
    "active_with_cap:i active_stale:i active_without_price:i",
    """SELECT count(*) FILTER (delisted_at IS NULL AND market_cap IS NOT NULL) AS active_with_cap,
      count(*) FILTER (delisted_at IS NULL AND (last_updated IS NULL OR last_updated < DATE '2001-11-09' - 7)) AS active_stale,
      count(*) FILTER (delisted_at IS NULL AND current_price IS NULL) AS active_without_price FROM coins""",
)(lambda ws: Q.liquidity_staleness(ws.coins, dt.date(2001, 11, 9)))
query(
    "delisted_list", "symbol:s delisted_at:d", "SELECT symbol, delisted_at FROM coins WHERE delisted_at IS NOT NULL"
)(lambda ws: Q.delisted_list(ws.coins))
query(
    "summary_strip",
    "tracked:i near25:i near50:i median:f6",
    """SELECT count(*) AS tracked, count(*) FILTER (distance <= 25) AS near25, count(*) FILTER (distance <= 50) AS near50,
      median(distance) AS median FROM board""",
)(lambda ws: B.summary_strip(board(ws)))
query(
    "robust_domain",
    "colour_max:f6 axis_max:f6 axis_all:f6 bar_max:f6 overflow:i",
    """WITH d AS (SELECT distance AS d FROM stats_o), l AS (SELECT greatest(quantile_cont(d, 0.9), 25) AS colour_max,
      greatest(quantile_cont(d, 0.95), 50) AS axis_max, greatest(max(d), 1) AS axis_all,
      greatest(quantile_cont(d, 0.95), 5) AS bar_max FROM d)
    SELECT *, (SELECT count(*) FROM d, l WHERE d.d > l.axis_max) AS overflow FROM l""",
)(lambda ws: B.robust_domain(stats_at(ws)))
query(
    "robust_domain_series",
    "colour_max:f6 axis_max:f6 axis_all:f6 bar_max:f6 overflow:i",
    """WITH d AS (SELECT distance_event AS d FROM dip), l AS (SELECT greatest(quantile_cont(d, 0.9), 25) AS colour_max,
      greatest(quantile_cont(d, 0.95), 50) AS axis_max, greatest(max(d), 1) AS axis_all,
      greatest(quantile_cont(d, 0.95), 5) AS bar_max FROM d)
    SELECT *, (SELECT count(*) FROM d, l WHERE d.d > l.axis_max) AS overflow FROM l""",
)(lambda ws: B.robust_domain(R.dip_history(ws.candles, EVENT), "distance_event"))
query(
    "cap_share",
    "symbol:s share:f8",
    "SELECT symbol, market_cap / sum(market_cap) OVER () AS share FROM board WHERE market_cap > 0 AND distance IS NOT NULL",
)(lambda ws: B.cap_share(board(ws)))
query(
    "distribution_strip",
    "symbol:s n:i min:f8 p05:f8 p25:f8 p50:f8 p75:f8 p95:f8 max:f8 percentile:i",
    """SELECT symbol, n, s[1] AS min, """
    + ", ".join(f"s[CAST(least(n - 1, floor({q} * n)) AS INTEGER) + 1] AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
    + """, s[-1] AS max, floor(100 * le / n + 0.5) AS percentile FROM (
      SELECT symbol, count(*) AS n, list_sort(list(close)) AS s, count(*) FILTER (close <= current_price) AS le FROM (
        SELECT c.symbol, c.close, q.current_price FROM candles c JOIN coins q USING (symbol)
        QUALIFY row_number() OVER (PARTITION BY c.symbol ORDER BY c.ts DESC) <= 1095) GROUP BY 1)""",
)(lambda ws: R.distribution_strip(ws.candles, ws.coins))
query(
    "panel_coverage",
    "rows:i anchors:i first_anchor:d last_anchor:d symbols:i archived_share:f4",
    """SELECT count(*) AS rows, count(DISTINCT anchor) AS anchors, min(anchor) AS first_anchor, max(anchor) AS last_anchor,
      count(DISTINCT symbol) AS symbols, avg(CASE WHEN market_cap_pit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS archived_share FROM panel_m""",
)(lambda ws: Q.panel_coverage(ws.panel()))
query(
    "data_fingerprint",
    "latest_candle:d rows:i content_hash:i tracked:i",
    """SELECT max(ts) AS latest_candle, count(*) AS rows,
      sum(CAST('0x' || substr(sha256(symbol || '|' || CAST(ts AS VARCHAR) || '|' || CAST(CAST(round(close * 1e6) AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT)) AS content_hash,
      (SELECT count(*) FROM coins) AS tracked FROM candles""",
)(lambda ws: Q.data_fingerprint(ws.candles, ws.coins))



def _report_sql() -> str:
    """Each section's check SQL, one row per metric."""
    parts = []
    sections = {
        "universe": "universe_counts", "candles": "candle_coverage", "candle_gaps": "candle_gaps",
        "market_history": "market_history_gaps", "liquidity": "liquidity_staleness", "provenance": "data_fingerprint",
    }
    for section, key in sections.items():
        q = REGISTRY[key]
        names = ", ".join(f"'{n}'" for n, _ in q.columns)
        values = ", ".join(f'CAST("{n}" AS VARCHAR)' for n, _ in q.columns)
        parts.append(f"SELECT '{section}' AS section, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM ({q.sql})")
    gone = "SELECT 'delisted_symbols' AS section, symbol AS metric, CAST(delisted_at AS VARCHAR) AS value FROM coins WHERE delisted_at IS NOT NULL"
    return "\nUNION ALL\n".join([*parts, gone])


def _report(ws):
    path = f"{shared_dir(ws.spark)}/report-json-{uuid.uuid4().hex}"
    sinks.write_report_json(Q.quality_report(ws.candles, ws.coins, ws.market_history, dt.date(2001, 11, 9)), path)
    return ws.spark.read.schema("section string, metric string, value string").json(path)


query("sink_report_json", "section:s metric:s value:s", _report_sql())(_report)

# --- board ------------------------------------------------------------------------------------
_BOARD = (
    "symbol:s name:s listing_date:d price:f8 price_7d:f8 price_30d:f8 market_cap:f2 volume_24h:f2 event_low:f8 atl:f8 "
    "distance:f4 distance_atl:f4 value_score:f1 part_valuation:f1 part_distance:f1 part_median_gap:f1 part_basing:f1 "
    f"part_range:f1 part_dip_respect:f1 knife:f1 bubble_size:f2 price_usd:f4 {spec(*STATS)}"
)
_P1 = ", ".join(f"{r1(f'part_{c}')} AS part_{c}" for c in ("valuation", "distance", "median_gap", "basing", "range", "dip_respect"))
_BOARD_SQL = f"SELECT * REPLACE ({_P1}) FROM board"
query("board_as_of", _BOARD, _BOARD_SQL)(board)
query("value_score", "symbol:s value_score:f1 part_valuation:f1 part_distance:f1 part_median_gap:f1 part_basing:f1 part_range:f1 part_dip_respect:f1 knife:f1", _BOARD_SQL + " WHERE value_score IS NOT NULL")(
    lambda ws: board(ws).filter("value_score is not null")
)
query(
    "live_board",
    "symbol:s market_cap:f2",
    "SELECT symbol, market_cap FROM coins WHERE current_price IS NOT NULL AND delisted_at IS NULL",
)(lambda ws: B.live_coins(ws.coins).orderBy(F.coalesce("market_cap", F.lit(-1.0)).desc(), "symbol"))
query(
    "live_prices",
    "symbol:s price:f8 price_7d:f8 price_30d:f8 atl:f8 event_low:f8 distance:f4 distance_atl:f4",
    """WITH p AS (SELECT symbol, max_by(close, ts) AS price, max_by(close, ts) FILTER (ts <= m - 7) AS price_7d,
      max_by(close, ts) FILTER (ts <= m - 30) AS price_30d, min(low) AS atl,
      coalesce(min(low) FILTER (ts >= DATE '1998-01-01'), min(low)) AS event_low
    FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS m FROM candles) GROUP BY 1)
    SELECT *, (price - event_low) / event_low * 100.0 AS distance, (price - atl) / atl * 100.0 AS distance_atl FROM p""",
)(lambda ws: B.price_columns(ws.coins, ws.candles, EVENT, ws.last_day))
query("usd_price", "symbol:s price_usd:f4", "SELECT symbol, price_usd FROM board")(board)
query("bubble_size", "symbol:s bubble_size:f2", "SELECT symbol, bubble_size FROM board")(board)
query(
    "distance_pct",
    "symbol:s ts:d distance_event:f5",
    "SELECT symbol, ts, distance_event FROM dip",
)(lambda ws: R.dip_history(ws.candles, EVENT))
query(
    "trend_delta",
    "symbol:s d7:f5 d30:f5",
    "SELECT symbol, (price - price_7d) / event_low * 100.0 AS d7, (price - price_30d) / event_low * 100.0 AS d30 FROM board",
)(
    lambda ws: board(ws).select(
        "symbol",
        *[B.trend_delta(F.col("price"), F.col(f"price_{k}d"), F.col("event_low")).alias(f"d{k}") for k in (7, 30)],
    )
)
query("drop_to_dip", "symbol:s drop:f6", "SELECT symbol, distance / (100.0 + distance) * 100.0 AS drop FROM board")(
    lambda ws: board(ws).select("symbol", B.drop_to_dip(F.col("distance")).alias("drop"))
)
query(
    "score_verdict",
    "symbol:s verdict:s",
    """SELECT symbol, CASE WHEN value_score IS NULL THEN 'NOT ENOUGH HISTORY FOR A SCORE YET'
      WHEN value_score >= 95 THEN 'CHEAPEST 5% OF TRACKED ALTS' WHEN value_score >= 80 THEN 'CHEAPEST 20% OF TRACKED ALTS'
      WHEN value_score >= 50 THEN 'CHEAPER THAN THE MEDIAN ALT' WHEN value_score >= 20 THEN 'EXPENSIVE HALF OF TRACKED ALTS'
      ELSE 'AMONG THE MOST EXPENSIVE ALTS' END AS verdict FROM board""",
)(lambda ws: board(ws).select("symbol", S.verdict(F.col("value_score")).alias("verdict")))
query(
    "score_eligibility",
    "symbol:s",
    f"SELECT symbol FROM board_rows WHERE {_gate}",
)(lambda ws: eligible(board(ws)))
query(
    "score_components",
    "symbol:s c_valuation:f6 c_distance:f5 c_median_gap:f4 c_basing:f4 c_range:f4 c_dip_respect:f6",
    "SELECT symbol, k_valuation AS c_valuation, k_distance AS c_distance, k_median_gap AS c_median_gap, k_basing AS c_basing, "
    "k_range AS c_range, k_dip_respect AS c_dip_respect FROM board_components",
)(lambda ws: with_components(eligible(board(ws))))


query(
    "rank_percentiles",
    "ts:d symbol:s pct:f6",
    """SELECT ts, symbol, CASE WHEN n > 1 THEN 100.0 * (r - 1 + (t - 1) / 2.0) / (n - 1) ELSE 50.0 END AS pct FROM (
      SELECT ts, symbol, rank() OVER (PARTITION BY ts ORDER BY volume) AS r, count(*) OVER (PARTITION BY ts, volume) AS t,
        count(*) OVER (PARTITION BY ts) AS n FROM candles)""",
)(lambda ws: rank_percentiles(ws.candles, ["ts"], ["symbol"], "volume", "pct"))

for _mode in ("any", "old", "new"):
    _where = {"any": "TRUE", "old": "listing_date < DATE '1995-01-05'", "new": "listing_date >= DATE '1995-01-05'"}[_mode]
    query(f"listing_filter_{_mode}", "symbol:s listing_date:d", f"SELECT * FROM board WHERE {_where}")(
        lambda ws, m=_mode: board(ws).filter(B.matches_listing(F.col("listing_date"), m, CUT))
    )
_OPTIONS = {"search": "brand#1", "min_cap": 9e7, "min_volume": 2.0e6, "listing": "old", "cutoff": CUT}
_FLAGS = """SELECT *, CASE WHEN is_stable THEN 'stables' WHEN NOT coalesce(listing_date < DATE '1995-01-05', FALSE) THEN 'listing'
  WHEN coalesce(market_cap, 0) < 9e7 THEN 'marketCap' WHEN coalesce(volume_24h, 0) < 2.0e6 THEN 'volume' {0}
  WHEN NOT contains(lower(symbol || ' ' || name || ' ' || base_asset), 'brand#1') THEN 'search' ELSE 'visible' END AS reason FROM board"""
_WATCH = "WHEN symbol NOT IN (SELECT symbol FROM watchlist) THEN 'watchlist'"
query("board_filter", "symbol:s market_cap:f2", f"SELECT * FROM ({_FLAGS.format('')}) WHERE reason = 'visible'")(
    lambda ws: B.board_filter(board(ws), ws.watchlist, **_OPTIONS)
)
query(
    "board_filter_watched", "symbol:s", "SELECT symbol FROM board WHERE NOT is_stable AND symbol IN (SELECT symbol FROM watchlist)"
)(lambda ws: B.board_filter(board(ws), ws.watchlist, watch_only=True))
query("hidden_reasons", "reason:s n:i", f"SELECT reason, count(*) AS n FROM ({_FLAGS.format(_WATCH)}) GROUP BY 1")(
    lambda ws: B.hidden_reasons(board(ws), ws.watchlist, watch_only=True, **_OPTIONS)
)

# --- F: top-k ----------------------------------------------------------------------------------
_MODES = {
    "closest": ("distance", "ASC"),
    "falling": ("(price - price_7d) / event_low * 100.0", "ASC"),
    "cheapest": ("valuation_pct_3y", "ASC"),
    "basing": ("basing_pct_90d", "DESC"),
    "value": ("value_score", "DESC"),
}
for _mode, (_metric, _dir) in _MODES.items():
    query(
        f"leaderboard_{_mode}",
        "symbol:s metric:f4 mode:s",
        f"""SELECT symbol, {_metric} AS metric, '{_mode}' AS mode FROM board WHERE {_metric} IS NOT NULL
        ORDER BY metric {_dir}, symbol LIMIT 10""",
    )(lambda ws, m=_mode: B.leaderboard(board(ws), m))
query("table_sort", "symbol:s value_score:f1", "SELECT symbol, value_score FROM board ORDER BY value_score DESC NULLS LAST, symbol")(
    lambda ws: B.table_sort(board(ws), F.col("value_score"), True)
)
query(
    "daily_digest",
    "symbol:s value_score:f1",
    "SELECT symbol, value_score FROM board WHERE value_score IS NOT NULL ORDER BY value_score DESC, symbol LIMIT 5",
)(lambda ws: B.leaderboard(board(ws), "value", limit=5).withColumnRenamed("metric", "value_score"))
query(
    "sink_board_csv",
    "symbol:s name:s current_price:f8 market_cap:f2 distance_pct_event:f4 valuation_pct_3y:f1 value_score:f1",
    "SELECT symbol, name, price AS current_price, market_cap, distance AS distance_pct_event, valuation_pct_3y, value_score FROM board",
)(lambda ws: _board_csv(ws))


def _board_csv(ws):
    import uuid

    from tidemark.session import shared_dir

    named = {
        "current_price": "price", "price_7d_ago": "price_7d", "price_30d_ago": "price_30d", "all_time_low": "atl",
        "distance_pct_event": "distance", "distance_pct_atl": "distance_atl", "trend_30d_pct": "trend_30d",
        "trend_90d_pct": "trend_90d",
    }
    rows = board(ws).withColumns({"price_verified": F.lit(None).cast("boolean"), "price_deviation_pct": F.lit(None).cast("double")})
    path = f"{shared_dir(ws.spark)}/board-csv-{uuid.uuid4().hex}"
    sinks.write_board_csv(rows.withColumns({k: F.col(v) for k, v in named.items()}), path)
    return ws.spark.read.option("header", True).option("escape", '"').csv(path)
