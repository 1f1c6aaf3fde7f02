"""Calendar, regime, feature and factor-research queries (sections I, J1, K)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.core import spec
from catalog.registry import EVENT, UNIVERSE, query
from catalog.sqlbase import CTES, FIRST, STEP, rank0
from tidemark.operators import research as K
from tidemark.operators.calendar import Calendar, regime_warmup_start
from tidemark.operators.lookback import EXTRAS, STATS
from tidemark.plans import panel as P

M = "monthly"

# --- J1: anchors -------------------------------------------------------------------------------
for _f in ("monthly", "weekly", "quarterly"):
    query(
        f"anchor_calendar_{_f}",
        "anchor:d idx:i next_anchor:d",
        f"SELECT anchor, idx, lead(anchor) OVER (ORDER BY anchor) AS next_anchor FROM anchors_{_f[0]}",
    )(lambda ws, f=_f: ws.calendar(f).frame(ws.spark))
CTES["late_start"] = "SELECT CAST(DATE '1999-06-15' - 8 * 7 AS DATE) AS s, max(ts) AS b FROM candles"
query(
    "anchor_calendar_warmup",
    "anchor:d idx:i",
    f"""SELECT CAST(d AS DATE) AS anchor, row_number() OVER (ORDER BY d) - 1 AS idx FROM (
      SELECT unnest(generate_series(CAST({FIRST["weekly"]} AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL {STEP["weekly"]})) AS d FROM late_start)""",
)(
    lambda ws: Calendar.for_history(
        "weekly", ws.bounds[0], ws.last_day, regime_warmup_start(dt.date(1999, 6, 15), "weekly")
    ).frame(ws.spark)
)

# --- I, E16, E17, C13-C15, D14, D15 --------------------------------------------------------------
query("panel_score", "anchor:d symbol:s score:f1", "SELECT anchor, symbol, score FROM panel_m")(lambda ws: ws.panel())
query(
    "alt_index",
    "anchor:d idx:i alt_return:f8 alt_index:l8 alt_above_sma:b alt_trend:f8",
    "SELECT * FROM regime_m",
)(lambda ws: P.alt_index(ws.panel(), ws.calendar(M)))
query("alt_index_return", "idx:i alt_return:f8", "SELECT idx, alt_return FROM altret_m")(
    lambda ws: P.alt_index(ws.panel(), ws.calendar(M)).filter("alt_return is not null")
)
query(
    "breadth", "anchor:d breadth:f8", "SELECT anchor, avg(CAST(above_sma200 AS DOUBLE)) AS breadth FROM panel_m GROUP BY 1"
)(lambda ws: P.breadth(ws.panel()))
query("regime_weekly", "anchor:d alt_above_sma:b breadth:f8", "SELECT * FROM regime_w")(
    lambda ws: P.regime(ws.panel("weekly"), ws.calendar("weekly"))
)
CTES["quote_regime"] = """
SELECT a.anchor, n.close / p30.close - 1.0 AS quote_return_30d, n.close / p90.close - 1.0 AS quote_return_90d,
  n.close > n.sma AS quote_above_sma200
FROM anchors_m a
ASOF LEFT JOIN (SELECT ts, close, avg(close) OVER (ORDER BY ts ROWS 199 PRECEDING) AS sma FROM rates) n ON a.anchor >= n.ts
ASOF LEFT JOIN rates p30 ON a.anchor - 30 >= p30.ts
ASOF LEFT JOIN rates p90 ON a.anchor - 90 >= p90.ts"""
query(
    "quote_regime",
    "anchor:d quote_return_30d:f8 quote_return_90d:f8 quote_above_sma200:b",
    "SELECT * FROM quote_regime",
)(lambda ws: P.quote_regime(ws.rates, ws.calendar(M)))
query(
    "feature_rows",
    "anchor:d symbol:s score:f1 price:f8 cap_current:f4 volume_current:f4 market_cap_pit:f4 volume_pit:f4 distance:f4 "
    f"{spec(*STATS, *EXTRAS)} quote_return_30d:f8 quote_return_90d:f8 quote_above_sma200:b alt_above_sma:b alt_trend:f8 breadth:f8",
    """SELECT p.* EXCLUDE (idx), p.cap AS cap_current, p.volume AS volume_current, q.* EXCLUDE (anchor),
      r.alt_above_sma, r.alt_trend, r.breadth
    FROM panel_m p LEFT JOIN quote_regime q USING (anchor) LEFT JOIN regime_m r USING (anchor)""",
)(lambda ws: P.feature_rows(ws.panel(), ws.rates, ws.calendar(M)))


def fwd(k: int) -> str:
    name = f"fwd{k}_m"
    CTES[name] = f"""
SELECT * FROM (SELECT a.idx, a.anchor, a.symbol, a.price, b.price AS next_price, b.price / a.price - 1.0 AS ret, a.score,
  a.distance, a.trend_30d, a.above_sma200, count(*) OVER (PARTITION BY a.idx) AS un
FROM panel_m a JOIN panel_m b ON b.symbol = a.symbol AND b.idx = a.idx + {k} WHERE a.price <> 0 AND b.price <> 0) WHERE un >= {UNIVERSE}"""
    return name


FWD = {k: fwd(k) for k in (1, 2, 3, 6)}
query("forward_returns", "anchor:d symbol:s ret:f8", f"SELECT * FROM {FWD[1]}")(
    lambda ws: P.forward_returns(ws.panel(), ws.calendar(M), 1, UNIVERSE)
)
query("forward_returns_step3", "anchor:d symbol:s ret:f8", f"SELECT * FROM {FWD[3]}")(
    lambda ws: P.forward_returns(ws.panel(), ws.calendar(M), 3, UNIVERSE)
)
query(
    "universe_overlap",
    "idx:i symbol:s",
    "SELECT a.idx, a.symbol FROM panel_m a WHERE EXISTS (SELECT 1 FROM panel_m b WHERE b.symbol = a.symbol AND b.idx = a.idx + 1)",
)(lambda ws: P.forward_pairs(ws.panel(), ws.calendar(M)))

# --- K ------------------------------------------------------------------------------------------
CTES["signals_m"] = "\nUNION ALL\n".join(
    f"SELECT idx, anchor, symbol, ret, '{n}' AS name, {e} AS value FROM fwd1_m"
    for n, e in {
        "score": "score",
        "distance_neg": "0.0 - coalesce(distance, 0)",
        "trend30": "coalesce(trend_30d, 0)",
        "sma200": "CASE WHEN above_sma200 THEN 1.0 ELSE 0.0 END",
    }.items()
)
CTES["ranked_m"] = f"""
SELECT *, {rank0("name, idx", "value")} AS rx, {rank0("name, idx", "ret")} AS ry FROM signals_m"""
CTES["ic_m"] = """
SELECT name, idx, anchor, count(*) AS n,
  CASE WHEN count(*) >= 3 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM ranked_m GROUP BY 1, 2, 3"""
CTES["spread_m"] = """
SELECT name, idx, anchor, avg(ret) FILTER (n - up < k) - avg(ret) FILTER (up <= k) AS spread FROM (
  SELECT *, row_number() OVER (PARTITION BY name, idx ORDER BY value, ret) AS up, count(*) OVER (PARTITION BY name, idx) AS n,
    greatest(1, floor(count(*) OVER (PARTITION BY name, idx) / 5)) AS k FROM signals_m) GROUP BY 1, 2, 3"""


def rows_(ws):
    return ws.keep("signal_rows", lambda: K.with_forward(ws.panel(), ws.calendar(M), 1, UNIVERSE))


def ic_(ws):
    return ws.keep("signal_ic", lambda: K.rank_ic(rows_(ws), ["name", "idx", "anchor"]))


def spread_(ws):
    return ws.keep("signal_spread", lambda: K.quintile_spread(rows_(ws), ["name", "idx", "anchor"]))


query("signal_library", "anchor:d symbol:s name:s value:f4", "SELECT * FROM signals_m")(rows_)
query("rank_ic", "name:s idx:i n:i ic:f8", "SELECT * FROM ic_m")(ic_)
query("quintile_spread", "name:s idx:i spread:f8", "SELECT * FROM spread_m")(spread_)
_SUMMARY = """SELECT {by}, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std,
  CASE WHEN stddev_samp(v) > 0 THEN avg(v) / stddev_samp(v) * sqrt(count(v)) ELSE 0 END AS t,
  avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS positive_share, count(v) AS n FROM {src} WHERE v IS NOT NULL GROUP BY {by}"""
SUM_SPEC = "mean:f8 std:f8 t:f6 positive_share:f6 n:i"
query("summary_stats", f"name:s {SUM_SPEC}", _SUMMARY.format(by="name", src="(SELECT name, spread AS v FROM spread_m)"))(
    lambda ws: K.summary_stats(spread_(ws), "spread", ["name"])
)
query(
    "per_year_ic",
    "year:i ic_mean:f8 spread_mean:f8 n:i",
    """SELECT year(anchor) AS year, avg(ic) AS ic_mean, avg(spread) AS spread_mean, count(ic) AS n
    FROM ic_m JOIN spread_m USING (name, idx, anchor) WHERE name = 'score' GROUP BY 1""",
)(lambda ws: K.per_year(ic_(ws).filter("name = 'score'"), spread_(ws).filter("name = 'score'")))
_HORIZON = "\nUNION ALL\n".join(
    f"""SELECT {k} AS step, corr(rx, ry) AS v FROM (SELECT idx, {rank0("idx", "score")} AS rx, {rank0("idx", "ret")} AS ry FROM {n}) GROUP BY idx
    HAVING min(rx) < max(rx) AND min(ry) < max(ry)"""
    for k, n in FWD.items()
)
query("ic_by_horizon", f"step:i {SUM_SPEC}", _SUMMARY.format(by="step", src=f"({_HORIZON})"))(
    lambda ws: K.ic_by_horizon(ws.panel(), ws.calendar(M), (1, 2, 3, 6), UNIVERSE)
)
query(
    "baseline_ic_report",
    f"section:s name:s {SUM_SPEC}",
    _SUMMARY.format(by="section, name", src="(SELECT 'ic' AS section, name, ic AS v FROM ic_m UNION ALL SELECT 'spread', name, spread FROM spread_m WHERE name = 'score')"),
)(lambda ws: K.baseline_report(ws.panel(), ws.calendar(M), UNIVERSE))
query("block_bootstrap_ci", "lo:f6 hi:f6")(
    lambda ws: K.block_bootstrap_ci(ic_(ws).filter("name = 'score'"), "ic", "idx")
)
_FOLDS = """SELECT row_number() OVER (ORDER BY t) - 1 AS fold, 0 AS train_start, t - 2 AS train_end, t AS test_start,
  least(n, t + 12) AS test_end, 1 AS horizon, 1 AS embargo
FROM (SELECT unnest(generate_series(26, n - 1, 12)) AS t, n FROM (SELECT count(*) AS n FROM anchors_m))"""
query(
    "walk_forward_folds",
    "fold:i train_start:i train_end:i test_start:i test_end:i horizon:i embargo:i",
    _FOLDS,
)(lambda ws: K.walk_forward_folds(ws.calendar(M).frame(ws.spark)))
query(
    "assert_no_overlap",
    "fold:i reason:s",
    f"SELECT fold, 'label overlap' AS reason FROM ({_FOLDS}) WHERE train_end - 1 + 3 >= test_start",
)(lambda ws: K.fold_violations(K.walk_forward_folds(ws.calendar(M).frame(ws.spark)), 3))
query(
    "proxy_curve",
    "total_return:l8 sharpe:f6 max_drawdown:f8 periods:i",
    """SELECT product(1 + r) - 1 AS total_return, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe, least(0, min(e / pk - 1)) AS max_drawdown,
      count(*) AS periods FROM (SELECT *, greatest(1, max(e) OVER (ORDER BY idx)) AS pk FROM (
        SELECT idx, alt_return AS r, product(1 + alt_return) OVER (ORDER BY idx) AS e FROM altret_m))""",
)(lambda ws: K.proxy_curve(P.alt_index(ws.panel(), ws.calendar(M)).filter("alt_return is not null"), "alt_return", "idx"))
query(
    "top_n_forward",
    "idx:i ret:f8",
    "SELECT idx, avg(ret) AS ret FROM (SELECT * FROM fwd1_m QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) <= 3) GROUP BY 1",
)(lambda ws: K.top_n_forward(P.forward_returns(ws.panel(), ws.calendar(M), 1, UNIVERSE, ("score",)), "score"))


def _leakage(ws):
    early = ws.candles.filter(F.col("ts") <= "2000-06-30")
    cal = Calendar.for_history(M, ws.bounds[0], dt.date(2000, 6, 30))
    # The archive is as-of too; the coin rows stay the same on both sides.
    old = P.point_in_time_panel(early, ws.market_history.filter(F.col("ts") <= "2000-06-30"), ws.coins, cal, EVENT)
    return K.leakage(old, ws.panel(), dt.date(2000, 6, 30))


query("leakage_check", "anchor:d symbol:s", "SELECT anchor, symbol FROM panel_m WHERE FALSE")(_leakage)
