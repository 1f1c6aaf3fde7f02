"""Common table expressions of the check SQL, written independently of the Spark plans.

The statistics are computed by joining every (symbol, anchor) with all earlier candles, the
plainest statement of their definition.
"""

from __future__ import annotations


def r1(x: str) -> str:
    """One decimal, ties to even on the exact binary value (10x = 8x + 2x with its exact error)."""
    s = "(x * 10.0)"
    err = f"((8.0 * x - ({s} - ({s} - 8.0 * x))) + (2.0 * x - ({s} - 8.0 * x)))"
    tie = f"({s} - floor({s}) = 0.5)"
    return (
        f"(list_transform([CAST({x} AS DOUBLE)], lambda x: CASE WHEN {tie} AND {err} > 0 THEN floor({s}) + 1 "
        f"WHEN {tie} AND {err} < 0 THEN floor({s}) ELSE round_even({s}, 0) END / 10.0))[1]"
    )


def pct(n_before: str, n: str, scale: str = "100.0") -> str:
    return f"CASE WHEN {n} > 1 THEN {scale} * ({n_before}) / ({n} - 1) ELSE {scale} / 2.0 END"


def rank0(part: str, value: str) -> str:
    """Average rank, 0-based, over a partition."""
    return (
        f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) - 1 "
        f"+ (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)"
    )


CTES: dict[str, str] = {}

CTES["trades"] = """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS px,
       l_quantity AS q, l_extendedprice AS ext,
       row(l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS k
FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTES["candles"] = """
SELECT symbol, ts, min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close,
       sum(q) AS volume, sum(ext) AS notional
FROM trades GROUP BY symbol, ts"""
CTES["rates"] = """
SELECT CAST(o_orderdate AS DATE) AS ts, max(o_totalprice) AS high, min(o_totalprice) AS low,
       avg(o_totalprice) AS close FROM orders GROUP BY 1"""
CTES["crn"] = """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
       sum(notional) OVER (PARTITION BY symbol ORDER BY ts) AS run_notional,
       sum(notional) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS notional30
FROM candles"""
CTES["market_history"] = """
SELECT symbol, ts, close AS price_usd, run_notional AS market_cap, notional30 AS volume_24h
FROM crn WHERE isodow(ts) = 1"""
CTES["coins"] = """
SELECT symbol, 'Asset ' || symbol AS name,
       CASE WHEN symbol <> 'Brand#22' THEN lower(replace(symbol, '#', '-')) END AS market_id,
       min(ts) AS listing_date,
       CASE WHEN symbol IN ('Brand#4', 'Brand#14') THEN max(ts) + 1 END AS delisted_at,
       min(ts) < DATE '1998-01-01' AS is_pre_cutoff,
       symbol = 'Brand#13' AS is_stable,
       sum(notional) AS market_cap, max_by(notional30, ts) AS volume_24h,
       max_by(close, ts) AS current_price, max(ts) AS last_updated
FROM crn GROUP BY symbol"""
CTES["watchlist"] = """
SELECT symbol, CASE WHEN symbol IN ('Brand#6', 'Brand#16') THEN 60.0 END AS threshold_pct,
       listing_date AS created_at
FROM coins WHERE symbol IN ('Brand#1', 'Brand#6', 'Brand#11', 'Brand#16', 'Brand#21')"""
CTES["bounds"] = "SELECT min(ts) AS a, max(ts) AS b, min(ts) + 400 AS s FROM candles"

FIRST = {
    "monthly": "CASE WHEN day(s) = 1 THEN s ELSE CAST(date_trunc('month', s) + INTERVAL 1 MONTH AS DATE) END",
    "quarterly": "CASE WHEN day(s) = 1 THEN s ELSE CAST(date_trunc('month', s) + INTERVAL 3 MONTH AS DATE) END",
    "weekly": "s + CAST((7 - (isodow(s) - 1)) % 7 AS INTEGER)",
}
STEP = {"monthly": "1 MONTH", "quarterly": "3 MONTH", "weekly": "7 DAY"}
SUFFIX = {"monthly": "m", "quarterly": "q", "weekly": "w", "once": "o"}

STATS = """
SELECT symbol, anchor, n AS history_days, last_ts, price, atl, coalesce(event_raw, atl) AS event_low,
  {v1} AS valuation_pct_1y, {v3} AS valuation_pct_3y, {va} AS valuation_pct_all,
  {m1} AS median_dist_1y, {m3} AS median_dist_3y,
  CASE WHEN n >= 30 AND hi > lo THEN round((price - lo) / (hi - lo), 3) END AS range_position,
  CASE WHEN n >= 30 THEN n - atl_rn END AS days_since_atl,
  {bas} AS basing_pct_90d, {t7} AS trend_7d, {t30} AS trend_30d, {t90} AS trend_90d, {t180} AS trend_180d,
  {t365} AS trend_365d,
  CASE WHEN n >= 60 THEN price > sma END AS above_sma200,
  {b05} AS band_p05_dist_3y, {b25} AS band_p25_dist_3y, {b75} AS band_p75_dist_3y, {b95} AS band_p95_dist_3y,
  CASE WHEN n >= 400 THEN round((p75 - p25) / p50, 3) END AS band_iqr_width_3y,
  CASE WHEN n >= 400 THEN round((p95 - p05) / p50, 3) END AS band_span_width_3y,
  CASE WHEN n >= 400 THEN CAST(price > p75 AS INTEGER) END AS above_p75_3y,
  CASE WHEN n >= 400 THEN CAST(price < p25 AS INTEGER) END AS below_p25_3y,
  {top} AS top_band_share_90d,
  CASE WHEN n >= 150 THEN coalesce(b.bounces, 0) + CAST(price <= s3[1] * 1.15 AS INTEGER) ELSE 0 END AS dip_touches,
  CASE WHEN n >= 150 THEN coalesce(b.bounces, 0) ELSE 0 END AS dip_bounces,
  {bav} AS dip_bounce_avg,
  CASE WHEN n30 >= 10 THEN sd30 END AS volatility_30d, CASE WHEN n90 >= 30 THEN sd90 END AS volatility_90d,
  price / hi - 1.0 AS drawdown_from_ath, n - ath_rn AS days_since_ath, dv30 AS dollar_volume_30d,
  (price - coalesce(event_raw, atl)) / coalesce(event_raw, atl) * 100.0 AS distance,
  (price - atl) / atl * 100.0 AS distance_atl
FROM levels_@ LEFT JOIN bounce_@ b USING (symbol, anchor)
""".format(
    v1=r1("CASE WHEN n >= 180 THEN 100.0 * le1 / len(s1) END"),
    v3=r1("CASE WHEN n >= 400 THEN 100.0 * le3 / len(s3) END"),
    va=r1("CASE WHEN n >= 180 THEN 100.0 * leall / n END"),
    m1=r1("CASE WHEN n >= 180 THEN (price - med1) / med1 * 100 END"),
    m3=r1("CASE WHEN n >= 400 THEN (price - med3) / med3 * 100 END"),
    bas=r1("CASE WHEN n >= 180 THEN 100.0 * len(list_filter(l90, lambda x: x <= q25)) / len(l90) END"),
    top=r1("CASE WHEN n >= 400 THEN 100.0 * len(list_filter(l90, lambda x: x >= p75)) / len(l90) END"),
    bav=r1("CASE WHEN n >= 150 AND b.bounces > 0 THEN 100.0 * b.gain / b.bounces END"),
    **{f"t{k}": r1(f"(price / c{k} - 1.0) * 100.0") for k in (7, 30, 90, 180, 365)},
    **{
        f"b{k}": r1(f"CASE WHEN n >= 400 THEN (price - p{k}) / p{k} * 100 END") for k in ("05", "25", "75", "95")
    },
)

COMPONENT_SQL = {
    "valuation": "-(0.5 * coalesce(valuation_pct_1y, valuation_pct_3y) + 0.3 * valuation_pct_3y "
    "+ 0.2 * coalesce(valuation_pct_all, valuation_pct_3y)) + 0.0",
    "distance": "0.0 - coalesce(distance, 0.0)",
    "median_gap": "0.0 - abs(coalesce(median_dist_3y, 0.0))",
    "basing": "coalesce(basing_pct_90d, 0.0)",
    "range": "0.0 - coalesce(range_position, 0.0)",
    "dip_respect": "coalesce(dip_bounces, 0) + coalesce(dip_bounce_avg, 0.0) / 50.0",
}
WEIGHTS = {
    "valuation": 0.27,
    "distance": 0.22,
    "median_gap": 0.14,
    "basing": 0.13,
    "range": 0.14,
    "dip_respect": 0.10,
}


def score_chain(source: str, prefix: str, where: str) -> dict[str, str]:
    """CTEs that score the rows of ``source`` passing ``where``, per anchor."""
    comp = ", ".join(f"{v} AS k_{k}" for k, v in COMPONENT_SQL.items())
    parts = ", ".join(
        f"{pct(rank0('anchor', f'k_{k}'), 'count(*) OVER (PARTITION BY anchor)')} * CAST({w} AS DOUBLE) AS part_{k}".replace(
            "CASE WHEN", "(CASE WHEN", 1
        ).replace(" END *", " END) *", 1)
        for k, w in WEIGHTS.items()
    )
    total = " + ".join(f"part_{k}" for k in WEIGHTS)
    return {
        f"{prefix}_components": f"""
SELECT symbol, anchor, {comp},
  CASE WHEN trend_30d < -40 OR trend_90d < -60 THEN CAST(-10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS knife
FROM {source} WHERE {where}""",
        f"{prefix}_parts": f"SELECT symbol, anchor, knife, {parts} FROM {prefix}_components",
        f"{prefix}_composite": f"SELECT *, ({total}) + knife AS composite FROM {prefix}_parts",
        f"{prefix}_scored": f"""
SELECT *, {r1("greatest(0.0, least(100.0, " + pct(rank0('anchor', 'composite'), 'count(*) OVER (PARTITION BY anchor)') + "))")}
  AS score FROM {prefix}_composite""",
    }


def _chain(freq: str) -> dict[str, str]:
    f = SUFFIX[freq]
    out = {}
    if freq == "once":
        out["anchors_@"] = "SELECT DATE '2000-06-30' AS anchor, 0 AS idx"
    else:
        out["anchors_@"] = f"""
SELECT CAST(d AS DATE) AS anchor, row_number() OVER (ORDER BY d) - 1 AS idx
FROM (SELECT unnest(generate_series(CAST({FIRST[freq]} AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL {STEP[freq]})) AS d
      FROM bounds)"""
    out["at_@"] = """
SELECT p.symbol, p.anchor, p.n, c.close AS price, c.ts AS last_ts
FROM (SELECT c.symbol, a.anchor, max(c.rn) AS n FROM crn c JOIN anchors_@ a ON c.ts <= a.anchor GROUP BY 1, 2) p
JOIN crn c ON c.symbol = p.symbol AND c.rn = p.n""" + ("" if freq == "once" else " WHERE p.n >= 400")
    out["rets"] = """
SELECT symbol, rn, CASE WHEN lag(close) OVER w > 0 AND close > 0 THEN ln(close / lag(close) OVER w) END AS lr
FROM crn WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
    out["win_@"] = """
SELECT s.symbol, s.anchor, s.n, s.price, s.last_ts, c.rn, s.n - c.rn AS age, c.close, c.low, c.ts, c.volume, r.lr
FROM at_@ s JOIN crn c ON c.symbol = s.symbol AND c.rn <= s.n
JOIN rets r ON r.symbol = c.symbol AND r.rn = c.rn"""
    out["agg_@"] = """
SELECT symbol, anchor, any_value(n) AS n, any_value(price) AS price, any_value(last_ts) AS last_ts,
  min(low) AS atl, arg_min(rn, row(low, rn)) AS atl_rn, arg_max(rn, row(close, rn)) AS ath_rn,
  min(low) FILTER (ts >= DATE '1998-01-01') AS event_raw, min(close) AS lo, max(close) AS hi,
  list_sort(list(close) FILTER (age < 365)) AS s1, list_sort(list(close) FILTER (age < 1095)) AS s3,
  list(close) FILTER (age < 90) AS l90,
  count(*) FILTER (age < 365 AND close <= price) AS le1, count(*) FILTER (age < 1095 AND close <= price) AS le3,
  count(*) FILTER (close <= price) AS leall, avg(close) FILTER (age < 200) AS sma,
  median(close) FILTER (age < 365) AS med1, median(close) FILTER (age < 1095) AS med3,
  stddev_samp(lr) FILTER (age < 30) AS sd30, count(lr) FILTER (age < 30) AS n30,
  stddev_samp(lr) FILTER (age < 90) AS sd90, count(lr) FILTER (age < 90) AS n90,
  avg(coalesce(volume, 0) * close) FILTER (age < 30) AS dv30,
  max(close) FILTER (age = 7) AS c7, max(close) FILTER (age = 30) AS c30, max(close) FILTER (age = 90) AS c90,
  max(close) FILTER (age = 180) AS c180, max(close) FILTER (age = 365) AS c365
FROM win_@ GROUP BY symbol, anchor"""
    q = "s3[CAST(floor({0} * (len(s3) - 1)) AS INTEGER) + 1] AS p{1}"
    out["levels_@"] = (
        "SELECT *, s1[CAST(greatest(0, floor(0.25 * len(s1)) - 1) AS INTEGER) + 1] AS q25, "
        + ", ".join(q.format(a, b) for a, b in ((0.05, "05"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.95, "95")))
        + " FROM agg_@"
    )
    out["peakwin_@"] = """
SELECT symbol, anchor, n, rn, close, row_number() OVER (PARTITION BY symbol, anchor ORDER BY rn) - 1 AS i,
  max(close) OVER (PARTITION BY symbol, anchor ORDER BY rn ROWS 30 PRECEDING) AS m31,
  min(close) OVER (PARTITION BY symbol, anchor ORDER BY rn ROWS 120 PRECEDING) AS tr,
  min(close) OVER (PARTITION BY symbol, anchor ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run
FROM win_@ WHERE age < 1095 AND n >= 150"""
    out["peaks_@"] = """
SELECT symbol, anchor, i, close / tr - 1.0 AS gain FROM (
  SELECT *, arg_min(run, close) OVER (PARTITION BY symbol, anchor ORDER BY rn ROWS 120 PRECEDING) AS run_tr
  FROM peakwin_@)
WHERE i >= 30 AND close >= m31 AND tr <= run_tr * 1.15 AND tr > 0 AND close / tr - 1.0 >= 0.3"""
    out["bounce_@"] = """
SELECT symbol, anchor, res.n AS bounces, res.g AS gain FROM (
  SELECT symbol, anchor, list_reduce(
    list_prepend({'nxt': 0::BIGINT, 'i': 0::BIGINT, 'n': 0::BIGINT, 'g': 0.0::DOUBLE},
      list({'nxt': 0::BIGINT, 'i': i::BIGINT, 'n': 0::BIGINT, 'g': gain::DOUBLE} ORDER BY i)),
    lambda acc, x: CASE WHEN x.i >= acc.nxt
      THEN {'nxt': x.i + 45, 'i': x.i, 'n': acc.n + 1, 'g': acc.g + x.g} ELSE acc END) AS res
  FROM peaks_@ GROUP BY symbol, anchor)"""
    out["stats_@"] = STATS
    if freq != "once":
        out["mkt_@"] = """
SELECT a.anchor, m.symbol, max_by(row(market_cap, volume_24h), m.ts) AS r
FROM anchors_@ a JOIN market_history m ON m.ts <= a.anchor GROUP BY 1, 2"""
        out["rows_@"] = """
SELECT s.*, m.r[1] AS market_cap_pit, m.r[2] AS volume_pit, coalesce(m.r[1], c.market_cap) AS cap,
  coalesce(m.r[2], c.volume_24h) AS volume
FROM stats_@ s JOIN coins c ON c.symbol = s.symbol AND NOT c.is_stable
LEFT JOIN mkt_@ m ON m.symbol = s.symbol AND m.anchor = s.anchor WHERE s.valuation_pct_3y IS NOT NULL"""
        gate = "coalesce(cap, 0) >= 10000000 AND coalesce(volume, 0) >= 250000"
        out.update(score_chain("rows_@", "gated_@", gate))
        out.update(score_chain("rows_@", "free_@", "TRUE"))
        out["panel_@"] = """
SELECT r.*, coalesce(g.score, f.score) AS score, a.idx FROM rows_@ r JOIN anchors_@ a USING (anchor)
LEFT JOIN gated_@_scored g USING (symbol, anchor) LEFT JOIN free_@_scored f USING (symbol, anchor)"""
    return {k.replace("@", f): v.replace("@", f) for k, v in out.items()}


for _freq in ("once", "monthly", "quarterly", "weekly"):
    CTES.update(_chain(_freq))

for _f in ("m", "w", "q"):
    CTES[f"pairs1_{_f}"] = f"""
SELECT a.idx, a.anchor, a.symbol, a.price, b.price AS next_price, b.price / a.price - 1.0 AS ret, a.score, a.distance,
  a.trend_30d, a.above_sma200
FROM panel_{_f} a JOIN panel_{_f} b ON b.symbol = a.symbol AND b.idx = a.idx + 1"""
    CTES[f"altret_{_f}"] = f"SELECT idx + 1 AS idx, avg(ret) AS alt_return FROM pairs1_{_f} GROUP BY 1"
    CTES[f"altlevel_{_f}"] = f"""
SELECT a.anchor, a.idx, r.alt_return, product(1.0 + coalesce(r.alt_return, 0.0)) OVER (ORDER BY a.idx) AS alt_index
FROM anchors_{_f} a LEFT JOIN altret_{_f} r USING (idx)"""
    CTES[f"regime_{_f}"] = f"""
SELECT anchor, idx, alt_return, alt_index, CASE WHEN idx >= 2 THEN alt_index > sma END AS alt_above_sma,
  alt_index / sma - 1.0 AS alt_trend, breadth
FROM (SELECT *, avg(alt_index) OVER (ORDER BY idx ROWS 5 PRECEDING) AS sma FROM altlevel_{_f})
LEFT JOIN (SELECT anchor, avg(CAST(above_sma200 AS DOUBLE)) AS breadth FROM panel_{_f} GROUP BY 1) USING (anchor)"""
