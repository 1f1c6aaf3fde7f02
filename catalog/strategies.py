"""Strategy queries (section J and the related parts of D, E, F and G)."""

from __future__ import annotations



from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlbase import CTES, rank0
from tidemark.operators import strategy as J
from tidemark.plans import panel as P
from tidemark.plans.presets import DEFAULTS, PRESETS, strategies

M = "monthly"

# A table of monthly strategies that exercises every set-wise rule.
CONFIGS = {
    "equal": {"top_n": 3, "min_score": 50.0},
    "by_score": {"top_n": 5, "min_score": 40.0, "weighting": "score", "regime_filter": "alt_trend", "fee_pct": 0.2},
    "by_cap": {"top_n": 4, "min_score": 60.0, "weighting": "market_cap", "fill_with_btc": False, "min_volume": 2_000_000.0,
               "regime_filter": "breadth", "regime_min_breadth": 0.45, "regime_exposure": 0.35},
    "shorts": {"top_n": 3, "min_score": 70.0, "short_n": 2, "short_max_score": 40.0, "short_funding_apr": 10.0,
               "short_exposure": 0.5, "min_trend_30d": -40.0},
    "inverted": {"top_n": 2, "min_score": 30.0, "invert_score": True, "short_n": 3, "short_funding_apr": 20.0,
                 "max_market_cap": 120_000_000.0},
    "timed": {"top_n": 4, "min_score": 50.0, "ic_filter": True, "ic_window": 4, "ic_threshold": 0.05, "ic_exposure": 0.35},
    "timed_flat": {"top_n": 4, "min_score": 50.0, "ic_filter": True, "ic_window": 6, "ic_exposure": 0.0},
}
CONFIGS = {k: {"frequency": M, **v} for k, v in CONFIGS.items()}
_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(value, kind):
    text = "NULL" if value is None else f"'{value}'"
    return f"CAST({text} AS {_SQL_TYPES[kind]})"


def values_sql(configs) -> str:
    rows = []
    for key, config in configs.items():
        cells = [f"'{key}' AS strategy_id"]
        cells += [f"{_literal(config.get(n, d), k)} AS {n}" for n, (k, d) in DEFAULTS.items()]
        rows.append("SELECT " + ", ".join(cells))
    return "\nUNION ALL\n".join(rows)


CTES["strats"] = values_sql(CONFIGS)


def strats(ws):
    return ws.keep("strats", lambda: strategies(ws.spark, CONFIGS))


def cal(ws):
    return ws.calendar(M)


def regime(ws):
    return ws.keep("regime", lambda: P.regime(ws.panel(), cal(ws)))


def book(ws):
    return ws.keep("book", lambda: J.book(ws.panel(), regime(ws), strats(ws), cal(ws)))


def periods(ws):
    return ws.keep("periods", lambda: J.periods(book(ws), ws.panel(), strats(ws), cal(ws)))


def curve(ws):
    return ws.keep("curve", lambda: J.equity_in_quote(J.equity_curve(periods(ws)), ws.rates, cal(ws)))


def trades(ws):
    return ws.keep("trades", lambda: J.trade_log(book(ws), ws.panel(), J.risk_flags(strats(ws), regime(ws)), strats(ws), cal(ws)))


_LIQ = "coalesce(cap, 0) >= min_market_cap AND (max_market_cap IS NULL OR coalesce(cap, 0) <= max_market_cap) AND coalesce(volume, 0) >= min_volume"
_SIGN = "CASE WHEN invert_score THEN -score ELSE score END"
CTES["cand"] = f"""
SELECT s.*, p.anchor, p.idx, p.symbol, p.score, p.distance, p.price, p.cap, p.volume FROM panel_m p CROSS JOIN strats s
WHERE CASE WHEN invert_score THEN score <= 100 - min_score ELSE score >= min_score END AND {_LIQ}
  AND (min_trend_30d IS NULL OR coalesce(trend_30d >= min_trend_30d, FALSE))"""
CTES["picks"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, anchor ORDER BY {_SIGN} DESC, distance ASC NULLS LAST, symbol) AS place
  FROM cand) WHERE place <= top_n"""
CTES["weighted"] = """
SELECT *, CASE weighting WHEN 'score' THEN score / CASE WHEN sum(score) OVER w = 0 THEN 1 ELSE sum(score) OVER w END
    WHEN 'market_cap' THEN CASE WHEN sum(coalesce(cap, 0)) OVER w <= 0 THEN 1.0 / count(*) OVER w ELSE coalesce(cap, 0) / sum(coalesce(cap, 0)) OVER w END
    ELSE 1.0 / count(*) OVER w END AS w0, count(*) OVER w / top_n AS filled
FROM picks WINDOW w AS (PARTITION BY strategy_id, anchor)"""
CTES["risk"] = """
SELECT s.strategy_id, r.anchor, r.idx, CASE regime_filter WHEN 'alt_trend' THEN coalesce(alt_above_sma, TRUE)
  WHEN 'breadth' THEN breadth IS NULL OR breadth >= regime_min_breadth ELSE TRUE END AS risk_on FROM regime_m r CROSS JOIN strats s"""
CTES["gated"] = """
SELECT w.*, risk_on, CASE WHEN fill_with_btc THEN w0 * filled ELSE w0 END
  * CASE WHEN risk_on THEN 1.0 ELSE greatest(0, least(1, regime_exposure)) END AS weight
FROM weighted w JOIN risk r USING (strategy_id, anchor) WHERE risk_on OR regime_exposure > 0"""
CTES["short_rows"] = f"""
SELECT *, -greatest(0, least(1, short_exposure)) / short_n AS weight FROM (
  SELECT s.*, p.anchor, p.idx, p.symbol, p.score, p.price,
    row_number() OVER (PARTITION BY strategy_id, p.anchor ORDER BY {_SIGN} ASC, p.symbol) AS place
  FROM panel_m p CROSS JOIN strats s WHERE short_n > 0 AND {_LIQ} AND (short_max_score IS NULL OR score <= short_max_score)
    AND NOT EXISTS (SELECT 1 FROM gated g WHERE g.strategy_id = s.strategy_id AND g.anchor = p.anchor AND g.symbol = p.symbol))
WHERE place <= short_n"""
CTES["aic"] = f"""
SELECT idx + 1 AS idx, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM (
  SELECT idx, {rank0("idx", "score")} AS rx, {rank0("idx", "ret")} AS ry, count(*) OVER (PARTITION BY idx) AS n FROM pairs1_m)
WHERE n >= 8 GROUP BY 1"""
CTES["ric"] = """
SELECT a.idx, a.anchor, w.w AS ic_window, (SELECT avg(ic) FROM (SELECT ic FROM aic b WHERE b.idx <= a.idx AND b.ic IS NOT NULL ORDER BY b.idx DESC LIMIT 4) WHERE w.w = 4) AS m4,
  (SELECT avg(ic) FROM (SELECT ic FROM aic b WHERE b.idx <= a.idx AND b.ic IS NOT NULL ORDER BY b.idx DESC LIMIT 6) WHERE w.w = 6) AS m6,
  (SELECT count(ic) FROM aic b WHERE b.idx <= a.idx) AS c
FROM anchors_m a CROSS JOIN (SELECT unnest([4, 6]) AS w) w"""
CTES["rolled"] = "SELECT idx, anchor, ic_window, CASE WHEN c >= 3 THEN coalesce(m4, m6) END AS rolling_ic FROM ric"
CTES["timing"] = """
SELECT s.strategy_id, r.anchor, r.rolling_ic, r.rolling_ic IS NULL OR r.rolling_ic > s.ic_threshold AS ic_risk_on
FROM rolled r JOIN strats s ON s.ic_window = r.ic_window AND s.ic_filter"""
CTES["book"] = """
SELECT strategy_id, anchor, idx, symbol, direction, score, price, fee_pct, short_funding_apr, rotation,
  weight * CASE WHEN coalesce(ic_risk_on, TRUE) THEN 1.0 ELSE greatest(0, least(1, ic_exposure)) END AS weight
FROM (SELECT strategy_id, anchor, idx, symbol, 'long' AS direction, score, price, fee_pct, short_funding_apr, rotation, ic_exposure, weight FROM gated
      UNION ALL SELECT strategy_id, anchor, idx, symbol, 'short', score, price, fee_pct, short_funding_apr, rotation, ic_exposure, weight FROM short_rows)
LEFT JOIN timing USING (strategy_id, anchor)"""
CTES["posret"] = """
SELECT b.*, CASE WHEN n.price IS NULL THEN 0.0 ELSE n.price / b.price - 1.0 END AS ret,
  CASE WHEN direction = 'short' THEN -1 ELSE 1 END * CASE WHEN n.price IS NULL THEN 0.0 ELSE n.price / b.price - 1.0 END AS pick_return
FROM book b LEFT JOIN panel_m n ON n.symbol = b.symbol AND n.idx = b.idx + 1
WHERE b.idx < (SELECT max(idx) FROM anchors_m) AND (direction = 'long' OR n.price IS NOT NULL)"""
CTES["traded"] = """
SELECT strategy_id, idx, sum(abs(d)) AS traded FROM (SELECT strategy_id, idx, symbol, sum(w) AS d FROM (
  SELECT strategy_id, idx, symbol, weight AS w FROM book UNION ALL SELECT strategy_id, idx + 1, symbol, -weight FROM book) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
CTES["per"] = """
SELECT f.*, coalesce(g.gross, 0) AS gross, coalesce(g.h, 0) AS holdings, coalesce(t.traded, 0) / 2 AS turnover,
  coalesce(t.traded, 0) * fee_pct / 100.0 AS fee, coalesce(b.sn, 0) AS short_notional, coalesce(b.ln, 0) AS long_notional,
  coalesce(b.sn, 0) * (short_funding_apr / 100.0) * greatest(next_anchor - anchor, 1) / 365.0 AS funding,
  coalesce(g.gross, 0) - (coalesce(t.traded, 0) * fee_pct / 100.0 + coalesce(b.sn, 0) * (short_funding_apr / 100.0) * greatest(next_anchor - anchor, 1) / 365.0) AS period_return
FROM (SELECT s.strategy_id, s.fee_pct, s.short_funding_apr, a.* FROM strats s CROSS JOIN
        (SELECT anchor, idx, lead(anchor) OVER (ORDER BY idx) AS next_anchor FROM anchors_m) a WHERE next_anchor IS NOT NULL) f
LEFT JOIN (SELECT strategy_id, idx, sum(weight * ret) AS gross, count(*) AS h FROM posret GROUP BY 1, 2) g USING (strategy_id, idx)
LEFT JOIN (SELECT strategy_id, idx, sum(CASE WHEN direction = 'short' THEN abs(weight) ELSE 0 END) AS sn,
  sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS ln FROM book GROUP BY 1, 2) b USING (strategy_id, idx)
LEFT JOIN traded t USING (strategy_id, idx)"""
CTES["curve"] = """
SELECT c.strategy_id, c.idx, c.anchor, c.period_return, c.equity, c.equity * r.rate / first_value(r.rate) OVER w AS equity_usd,
  r.rate / first_value(r.rate) OVER w AS benchmark_usd
FROM (SELECT strategy_id, 0 AS idx, anchor, 0.0 AS period_return, 1.0 AS equity FROM per WHERE idx = 0
      UNION ALL SELECT strategy_id, idx + 1, next_anchor, period_return, product(1.0 + period_return) OVER (PARTITION BY strategy_id ORDER BY idx) FROM per) c
JOIN (SELECT a.anchor, coalesce(q.close, (SELECT min_by(close, ts) FROM rates)) AS rate FROM anchors_m a ASOF LEFT JOIN rates q ON a.anchor >= q.ts) r USING (anchor)
WINDOW w AS (PARTITION BY c.strategy_id ORDER BY c.idx)"""
CTES["dd"] = "SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY idx) AS peak FROM curve"

SP = "strategy_id:s "
query("strategy_candidates", SP + "anchor:d symbol:s score:f1", "SELECT * FROM cand")(
    lambda ws: J.candidates(ws.panel(), strats(ws))
)
query("top_n_per_anchor", SP + "anchor:d symbol:s place:i", "SELECT * FROM picks")(
    lambda ws: J.picks_rebalance(ws.panel(), strats(ws))
)
query(
    "picks_rebalance",
    SP + "anchor:d symbol:s place:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, anchor ORDER BY CASE WHEN invert_score THEN -score ELSE score END DESC,
      distance ASC NULLS LAST, symbol) AS place FROM cand c WHERE NOT EXISTS (SELECT 1 FROM picks p WHERE p.place = 1
      AND p.strategy_id = c.strategy_id AND p.idx + 1 = c.idx AND p.symbol = c.symbol)) WHERE place <= top_n""",
)(lambda ws: _blocked_picks(ws))


def _blocked_picks(ws):
    first = P.numbered(J.picks_rebalance(ws.panel(), strats(ws)).filter("place = 1"), cal(ws))
    nxt = cal(ws).frame(ws.spark).select("anchor", (F.col("idx") - 1).alias("idx"))
    blocked = first.drop("anchor").join(nxt, "idx").select("strategy_id", "anchor", "symbol")
    return J.picks_rebalance(ws.panel(), strats(ws), blocked)


query("weights", SP + "anchor:d symbol:s weight:f8", "SELECT *, w0 AS weight FROM weighted")(
    lambda ws: J.weights(J.picks_rebalance(ws.panel(), strats(ws)))
)
query(
    "fill_with_btc",
    SP + "anchor:d symbol:s weight:f8",
    "SELECT *, CASE WHEN fill_with_btc THEN w0 * filled ELSE w0 END AS weight FROM weighted",
)(lambda ws: J.fill_with_numeraire(J.weights(J.picks_rebalance(ws.panel(), strats(ws)))))
query("regime_gate", SP + "anchor:d symbol:s weight:f8 risk_on:b", "SELECT * FROM gated")(
    lambda ws: J.regime_gate(
        J.fill_with_numeraire(J.weights(J.picks_rebalance(ws.panel(), strats(ws)))), J.risk_flags(strats(ws), regime(ws))
    )
)
query("short_sleeve", SP + "anchor:d symbol:s weight:f8", "SELECT * FROM book WHERE direction = 'short'")(
    lambda ws: book(ws).filter("direction = 'short'")
)
query("invert_score", SP + "anchor:d symbol:s score:f1 place:i", "SELECT * FROM picks WHERE invert_score")(
    lambda ws: J.picks_rebalance(ws.panel(), strats(ws).filter("invert_score"))
)
query("anchor_ic", "idx:i ic:f8", "SELECT * FROM aic")(lambda ws: J.anchor_ic(ws.panel(), cal(ws)))
query("rolling_ic", "idx:i rolling_ic:f8", "SELECT * FROM rolled WHERE ic_window = 6")(
    lambda ws: J.rolling_ic(J.anchor_ic(ws.panel(), cal(ws)), cal(ws).frame(ws.spark), 6)
)
query("ic_timing", SP + "anchor:d rolling_ic:f8 ic_risk_on:b", "SELECT * FROM timing")(
    lambda ws: J.ic_flags(ws.panel(), cal(ws), strats(ws))
)
query("strategy_book", SP + "anchor:d symbol:s direction:s weight:f8", "SELECT * FROM book")(book)
query("period_returns", SP + "idx:i symbol:s direction:s weight:f8 pick_return:f8", "SELECT * FROM posret")(
    lambda ws: J.position_returns(book(ws), ws.panel(), cal(ws))
)
query("turnover_sum", SP + "idx:i traded:f8", "SELECT * FROM traded")(lambda ws: J.turnover(book(ws)))
query(
    "weight_symbols",
    SP + "idx:i symbol:s",
    "SELECT strategy_id, idx, symbol FROM book UNION SELECT strategy_id, idx + 1, symbol FROM book",
)(
    lambda ws: book(ws).select("strategy_id", "idx", "symbol").union(
        book(ws).select("strategy_id", F.col("idx") + 1, "symbol")
    ).distinct()
)
query("fees_turnover", SP + "idx:i fee:f8 turnover:f8", "SELECT * FROM per")(periods)
query("funding_cost", SP + "idx:i funding:f8 short_notional:f8", "SELECT * FROM per")(periods)
query("equity_curve", SP + "idx:i anchor:d period_return:f8 equity:l8", "SELECT * FROM curve")(curve)
query("equity_usd", SP + "idx:i equity_usd:l8 benchmark_usd:f6", "SELECT * FROM curve")(curve)
query("drawdown_series", SP + "idx:i drawdown:f8", "SELECT *, equity / peak - 1 AS drawdown FROM dd")(
    lambda ws: J.drawdowns(curve(ws))
)
query(
    "weighted_period_return",
    SP + "idx:i ret:f8",
    "SELECT strategy_id, idx, sum(weight * pick_return) AS ret FROM posret GROUP BY 1, 2",
)(lambda ws: J.weighted_period_return(J.position_returns(book(ws), ws.panel(), cal(ws))))
METRICS_SQL = """
SELECT p.*, c.f - 1 AS total_return, c.u - 1 AS total_return_usd, c.b - 1 AS benchmark_return,
  pow(c.f, 1.0 / (c.days / 365.0)) - 1 AS cagr, p.s * sqrt(365.0 / 30) AS volatility,
  CASE WHEN p.s > 0 THEN p.m / p.s * sqrt(365.0 / 30) ELSE 0 END AS sharpe, c.md AS max_drawdown,
  CASE WHEN c.md < 0 THEN (pow(c.f, 1.0 / (c.days / 365.0)) - 1) / abs(c.md) END AS calmar
FROM (SELECT strategy_id, avg(period_return) AS m, stddev_samp(period_return) AS s, avg(CASE WHEN period_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
        avg(holdings) AS avg_holdings, avg(turnover) AS avg_turnover, avg(short_notional) AS avg_short_notional,
        avg(long_notional) AS avg_long_notional, sum(funding) AS funding_cost, count(*) AS periods FROM per GROUP BY 1) p
JOIN (SELECT strategy_id, max_by(equity, idx) AS f, max_by(equity_usd, idx) AS u, max_by(benchmark_usd, idx) AS b,
        least(0, min(equity / peak - 1)) AS md, max(anchor) - min(anchor) AS days FROM dd GROUP BY 1) c USING (strategy_id)"""
query(
    "performance_metrics",
    SP + "total_return:l8 total_return_usd:l8 benchmark_return:f6 cagr:l8 volatility:l8 sharpe:f6 max_drawdown:f6 calmar:l8 "
    "win_rate:f6 avg_holdings:f6 avg_turnover:f6 avg_short_notional:f6 avg_long_notional:f6 funding_cost:f6 periods:i",
    METRICS_SQL,
)(lambda ws: J.performance_metrics(curve(ws), periods(ws), M))
_ROLL = """SELECT strategy_id, avg(CASE WHEN e1 / e0 > 1 THEN 1.0 ELSE 0.0 END) AS positive_rolling_share FROM (
  SELECT strategy_id, equity AS e1, lag(equity, 12) OVER (PARTITION BY strategy_id ORDER BY idx) AS e0 FROM curve) WHERE e0 IS NOT NULL GROUP BY 1"""
query(
    "consistency_metrics",
    SP + "positive_years:f6 positive_rolling_share:f6 time_in_drawdown:f6 best_period_share:f6",
    f"""SELECT * FROM (SELECT strategy_id, avg(CASE WHEN e / coalesce(pe, 1.0) - 1 > 0 THEN 1.0 ELSE 0.0 END) AS positive_years FROM (
        SELECT strategy_id, y, e, lag(e) OVER (PARTITION BY strategy_id ORDER BY y) AS pe FROM (
          SELECT strategy_id, year(anchor) AS y, max_by(equity, idx) AS e FROM curve GROUP BY 1, 2)) GROUP BY 1)
    JOIN ({_ROLL}) USING (strategy_id)
    JOIN (SELECT strategy_id, avg(CASE WHEN equity < peak - 1e-12 THEN 1.0 ELSE 0.0 END) AS time_in_drawdown FROM dd GROUP BY 1) USING (strategy_id)
    JOIN (SELECT strategy_id, coalesce(sum(period_return) FILTER (r <= 3 AND period_return > 0) / sum(period_return) FILTER (period_return > 0), 1.0) AS best_period_share FROM (
        SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY period_return DESC, idx) AS r FROM per) GROUP BY 1) USING (strategy_id)""",
)(lambda ws: J.consistency_metrics(curve(ws), ["strategy_id"], M))
query(
    "positive_ic_share",
    "positive_ic_share:f8",
    "SELECT avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ic_share FROM aic WHERE ic IS NOT NULL",
)(lambda ws: J.anchor_ic(ws.panel(), cal(ws)).filter("ic is not null").agg(F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_share")))
CTES["lastidx"] = "SELECT max(idx) AS li FROM anchors_m"
CTES["trade_rows"] = """
SELECT s.strategy_id, s.symbol, s.entry_anchor, s.entry_price, s.entry_score, a.anchor AS exit_anchor,
  coalesce(q.price, s.last_price) AS exit_price,
  CASE WHEN s.nidx = (SELECT li FROM lastidx) THEN 'open' WHEN NOT coalesce(r.risk_on, TRUE) THEN 'regime'
       WHEN s.rotation = 'rebalance' THEN 'rebalance' WHEN q.price IS NULL THEN 'missing' ELSE 'score' END AS reason,
  coalesce(q.price, s.last_price) / s.entry_price - 1.0 AS ret, a.anchor - s.entry_anchor AS days
FROM (SELECT strategy_id, symbol, g, min(anchor) AS entry_anchor, min_by(price, idx) AS entry_price, min_by(score, idx) AS entry_score,
        max_by(price, idx) AS last_price, max(idx) + 1 AS nidx, any_value(rotation) AS rotation FROM (
        SELECT *, idx - row_number() OVER (PARTITION BY strategy_id, symbol ORDER BY idx) AS g FROM book
        WHERE direction = 'long' AND idx < (SELECT li FROM lastidx)) GROUP BY 1, 2, 3) s
JOIN anchors_m a ON a.idx = s.nidx LEFT JOIN panel_m q ON q.symbol = s.symbol AND q.idx = s.nidx
LEFT JOIN risk r ON r.strategy_id = s.strategy_id AND r.idx = s.nidx"""
query(
    "trade_log_rebalance",
    SP + "symbol:s entry_anchor:d entry_price:f8 entry_score:f1 exit_anchor:d exit_price:f8 reason:s ret:f8 days:i",
    "SELECT * FROM trade_rows",
)(trades)
query("exit_reason", SP + "reason:s n:i", "SELECT strategy_id, reason, count(*) AS n FROM trade_rows GROUP BY 1, 2")(
    lambda ws: trades(ws).groupBy("strategy_id", "reason").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "trade_stats",
    SP + "total:i open:i win_rate:f6 mean:f8 best:f8 worst:f8",
    """SELECT strategy_id, count(*) AS total, count(*) FILTER (reason = 'open') AS open,
      coalesce(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (reason <> 'open'), 0) AS win_rate,
      coalesce(avg(ret) FILTER (reason <> 'open'), 0) AS mean, coalesce(max(ret) FILTER (reason <> 'open'), 0) AS best,
      coalesce(min(ret) FILTER (reason <> 'open'), 0) AS worst FROM trade_rows GROUP BY 1""",
)(lambda ws: J.trade_stats(trades(ws)))
query(
    "short_spells",
    SP + "symbol:s entry_anchor:d entry_price:f8 last_price:f8 periods_held:i",
    """SELECT strategy_id, symbol, min(anchor) AS entry_anchor, min_by(price, idx) AS entry_price, max_by(price, idx) AS last_price,
      count(*) - 1 AS periods_held FROM (SELECT *, idx - row_number() OVER (PARTITION BY strategy_id, symbol ORDER BY idx) AS g
      FROM book WHERE direction = 'short') GROUP BY 1, 2, g""",
)(lambda ws: J.short_spells(book(ws)))

# --- hold rotation and exits ---------------------------------------------------------------------
HOLD = {
    "wide": {"min_score": 70.0, "sell_score": 40.0, "max_holding_periods": 4, "profit_sweep_pct": 50.0, "stop_loss_pct": 60.0, "trailing_stop_pct": 80.0},
    "same": {"min_score": 60.0, "max_holding_periods": 3, "profit_sweep_pct": 70.0, "take_profit_pct": 300.0, "trailing_stop_pct": 90.0},
    "upside": {"min_score": 30.0, "invert_score": True, "sell_score": 10.0, "stop_loss_pct": 50.0, "take_profit_pct": 100.0},
}
HOLD = {k: {"frequency": M, "rotation": "hold", **v} for k, v in HOLD.items()}
CTES["hold_strats"] = values_sql(HOLD)
# Membership by recursion over the anchors: in = candidate now, or in before and still at the sell score.
CTES["hold_rows"] = f"""
SELECT s.*, p.anchor, p.idx, p.symbol, p.score, p.price,
  CASE WHEN invert_score THEN p.score <= 100 - min_score ELSE p.score >= min_score END AND {_LIQ} AS enter,
  p.score >= coalesce(sell_score, min_score) AS stay FROM panel_m p CROSS JOIN hold_strats s"""
CTES["members"] = """
WITH RECURSIVE h AS (
  SELECT strategy_id, symbol, idx FROM hold_rows WHERE enter
  UNION
  SELECT r.strategy_id, r.symbol, r.idx FROM h JOIN hold_rows r ON r.strategy_id = h.strategy_id AND r.symbol = h.symbol AND r.idx = h.idx + 1 AND r.stay)
SELECT DISTINCT r.* FROM h JOIN hold_rows r USING (strategy_id, symbol, idx)"""
CTES["held"] = """
SELECT *, row_number() OVER s - 1 AS held, first_value(price) OVER s AS entry_price, max(price) OVER s AS peak FROM (
  SELECT *, idx - row_number() OVER (PARTITION BY strategy_id, symbol ORDER BY idx) AS spell FROM members)
WINDOW s AS (PARTITION BY strategy_id, symbol, spell ORDER BY idx)"""


def hold_strats(ws):
    return strategies(ws.spark, HOLD)


def members(ws):
    params = hold_strats(ws).select("strategy_id", "max_holding_periods", "profit_sweep_pct", "stop_loss_pct", "trailing_stop_pct", "take_profit_pct")
    return ws.keep("members", lambda: J.hysteresis_members(ws.panel(), hold_strats(ws), cal(ws)).join(params, "strategy_id"))


query(
    "hysteresis_spells",
    SP + "symbol:s idx:i held:i entry_price:f8",
    "SELECT * FROM held",
)(lambda ws: J.spells(members(ws)))
query(
    "time_stop",
    SP + "symbol:s idx:i held:i",
    """SELECT * REPLACE (CASE WHEN max_holding_periods IS NULL THEN held ELSE held % (max_holding_periods + 2) END AS held) FROM held
    WHERE max_holding_periods IS NULL OR held % (max_holding_periods + 2) < max_holding_periods""",
)(lambda ws: J.time_stop(members(ws)))


def walk_sql(rows: str, anchors: str, closes: str) -> str:
    """Position paths by recursion over the anchors: `rows` as hold_rows, `closes` the closes of each (symbol, period)."""
    return f"""
WITH RECURSIVE w AS (
  SELECT strategy_id, symbol, -1 AS idx, FALSE AS has, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS peak, CAST(1 AS DOUBLE) AS keep, 0 AS held,
    -9 AS blocked, FALSE AS member, FALSE AS timed, CAST(NULL AS BIGINT) AS x, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS top,
    CAST(NULL AS DOUBLE) AS exit_price, CAST(NULL AS DATE) AS exit_ts, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DATE) AS anchor
  FROM (SELECT DISTINCT strategy_id, symbol FROM {rows} WHERE enter)
  UNION ALL
  SELECT strategy_id, symbol, n, member AND x IS NULL, entry, CASE WHEN member THEN greatest(peak, coalesce(pm[-1], peak)) ELSE peak END, keep, held,
    CASE WHEN x IS NOT NULL OR timed THEN n + 1 ELSE blocked END, member, timed, x, price, peak, cl[x], days[x],
    CASE WHEN cl[x] <= entry * (1.0 - stop_loss_pct / 100.0) THEN 'stop_loss'
      WHEN cl[x] <= greatest(peak, pm[x]) * (1.0 - trailing_stop_pct / 100.0) THEN 'trailing_stop' ELSE 'take_profit' END, anchor
  FROM (SELECT *, CASE WHEN member THEN nullif(list_position(list_transform(range(1, len(cl) + 1), lambda i:
          coalesce(cl[i] <= entry * (1.0 - stop_loss_pct / 100.0), FALSE) OR coalesce(cl[i] <= greatest(peak, pm[i]) * (1.0 - trailing_stop_pct / 100.0), FALSE)
          OR coalesce(cl[i] >= entry * (1.0 + take_profit_pct / 100.0), FALSE)), TRUE), 0) END AS x
    FROM (SELECT w.strategy_id, w.symbol, w.idx + 1 AS n, r.anchor, r.price, w.blocked, r.stop_loss_pct, r.trailing_stop_pct, r.take_profit_pct, c.cl, c.pm, c.days,
        (w.has AND coalesce(r.stay OR r.enter, FALSE)) AS holds, coalesce(holds AND w.held + 1 >= r.max_holding_periods, FALSE) AS timed,
        CASE WHEN holds THEN NOT timed ELSE coalesce(r.enter, FALSE) AND w.blocked <> w.idx + 1 END AS member,
        CASE WHEN holds THEN w.entry ELSE r.price END AS entry, CASE WHEN holds THEN greatest(w.peak, r.price) ELSE r.price END AS peak,
        CASE WHEN holds THEN w.held + 1 ELSE 0 END AS held,
        CASE WHEN NOT holds THEN 1.0 WHEN r.price > w.entry AND w.entry <> 0
          THEN w.keep * (1 - least(0.9, coalesce(r.profit_sweep_pct, 0) / 100.0 * (r.price / w.entry - 1) / (r.price / w.entry))) ELSE w.keep END AS keep
      FROM w LEFT JOIN {rows} r ON r.strategy_id = w.strategy_id AND r.symbol = w.symbol AND r.idx = w.idx + 1
      LEFT JOIN {closes} c ON c.symbol = w.symbol AND c.idx = w.idx + 1
      WHERE w.idx < (SELECT max(idx) FROM {anchors}))))
SELECT strategy_id, symbol, 'member' AS kind, idx, price, held, entry AS entry_price, top AS peak, keep, anchor AS ts, NULL AS reason FROM w WHERE member
UNION ALL SELECT strategy_id, symbol, 'exit', idx, exit_price, held, entry, peak_at, keep, exit_ts, reason FROM (
  SELECT w.*, greatest(top, c.pm[x]) AS peak_at FROM w JOIN {closes} c USING (symbol, idx) WHERE x IS NOT NULL)
UNION ALL SELECT strategy_id, symbol, 'time', idx, price, held, entry, top, keep, anchor, 'time' FROM w WHERE timed"""


def closes_sql(anchors: str) -> str:
    return f"""
SELECT symbol, idx, cl, days, list_transform(range(1, len(cl) + 1), lambda i: list_max(cl[1:i])) AS pm FROM (
  SELECT c.symbol, a.idx, list(c.close ORDER BY c.ts) AS cl, list(c.ts ORDER BY c.ts) AS days FROM candles c
  JOIN (SELECT idx, anchor, lead(anchor) OVER (ORDER BY idx) AS nxt FROM {anchors}) a ON c.ts > a.anchor AND (a.nxt IS NULL OR c.ts <= a.nxt) GROUP BY 1, 2)"""


CTES["closes_m"] = closes_sql("anchors_m")
CTES["paths"] = walk_sql("hold_rows", "anchors_m", "closes_m")
PATH = SP + "symbol:s kind:s idx:i price:f8 held:i entry_price:f8 peak:f8 keep:f8 ts:d reason:s"


def paths(ws):
    return ws.keep("paths", lambda: J.position_paths(ws.panel(), hold_strats(ws), ws.candles, cal(ws)))


query("position_paths", PATH, "SELECT * FROM paths")(paths)
query("blocked_union", SP + "idx:i symbol:s", "SELECT DISTINCT strategy_id, idx + 1 AS idx, symbol FROM paths WHERE kind <> 'member'")(
    lambda ws: J.blocked_union(paths(ws))
)
CTES["exit_book"] = """
SELECT m.strategy_id, m.symbol, m.idx, m.ts AS anchor, m.price, m.keep, x.price AS exit_price,
  m.keep / count(*) OVER w * least(count(*) OVER w / s.top_n, 1) AS weight
FROM (SELECT * FROM paths WHERE kind = 'member') m JOIN hold_strats s USING (strategy_id)
LEFT JOIN (SELECT * FROM paths WHERE kind = 'exit') x ON x.strategy_id = m.strategy_id AND x.symbol = m.symbol AND x.idx = m.idx
WINDOW w AS (PARTITION BY m.strategy_id, m.idx)"""


def exit_book(ws):
    return ws.keep("exit_book", lambda: J.book(ws.panel(), regime(ws), hold_strats(ws), cal(ws), ws.candles))


query("book_with_exits", SP + "anchor:d symbol:s weight:f8 keep:f8 exit_price:f8", "SELECT * FROM exit_book")(exit_book)
query(
    "returns_with_exits",
    SP + "idx:i gross:f8",
    """SELECT b.strategy_id, b.idx, sum(b.weight * (coalesce(b.exit_price, n.price, b.price) / b.price - 1)) AS gross
    FROM exit_book b LEFT JOIN panel_m n ON n.symbol = b.symbol AND n.idx = b.idx + 1 WHERE b.idx < (SELECT max(idx) FROM anchors_m) GROUP BY 1, 2""",
)(
    lambda ws: J.position_returns(exit_book(ws), ws.panel(), cal(ws)).groupBy("strategy_id", "idx").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
)

# The named presets that feed no equity back, each on the panel of its own frequency.
RUNNABLE = {k: v for k, v in PRESETS.items() if not set(v) & set(J.EQUITY_RULES)}
CTES["presets"] = values_sql(RUNNABLE)
for _f in ("weekly", "quarterly"):
    CTES[f"preset_rows_{_f[0]}"] = f"""
SELECT s.*, p.anchor, p.idx, p.symbol, p.score, p.price, p.score >= min_score AND {_LIQ} AND (min_trend_30d IS NULL OR coalesce(trend_30d >= min_trend_30d, FALSE)) AS enter,
  p.score >= coalesce(sell_score, min_score) AS stay FROM panel_{_f[0]} p JOIN presets s ON s.frequency = '{_f}'"""
    CTES[f"closes_{_f[0]}"] = closes_sql(f"anchors_{_f[0]}")
    CTES[f"preset_paths_{_f[0]}"] = walk_sql(f"preset_rows_{_f[0]}", f"anchors_{_f[0]}", f"closes_{_f[0]}")


def preset_book(ws, frequency: str):
    chosen = strategies(ws.spark, RUNNABLE).filter(F.col("frequency") == frequency)
    c = ws.calendar(frequency)
    return J.book(ws.panel(frequency), P.regime(ws.panel(frequency), c), chosen, c, ws.candles)


query(
    "preset_positions",
    SP + "anchor:d symbol:s keep:f8 exit_price:f8",
    "\nUNION ALL\n".join(
        f"""SELECT m.strategy_id, m.ts AS anchor, m.symbol, m.keep, x.price AS exit_price FROM preset_paths_{f} m
        LEFT JOIN preset_paths_{f} x ON x.kind = 'exit' AND x.strategy_id = m.strategy_id AND x.symbol = m.symbol AND x.idx = m.idx WHERE m.kind = 'member'"""
        for f in "wq"
    ),
)(
    lambda ws: preset_book(ws, "weekly").unionByName(preset_book(ws, "quarterly")).filter("direction = 'long'")
)
query(
    "profit_sweep",
    SP + "symbol:s idx:i keep:f8",
    """SELECT *, product(CASE WHEN held > 0 AND price > entry_price THEN 1 - least(0.9, profit_sweep_pct / 100.0 * (price / entry_price - 1) / (price / entry_price)) ELSE 1 END)
      OVER (PARTITION BY strategy_id, symbol, spell ORDER BY idx) AS keep FROM held""",
)(lambda ws: J.profit_sweep(members(ws)))


def open_positions(ws):
    from pyspark.sql import Window

    w = Window.partitionBy("strategy_id", "symbol", "spell").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return J.spells(members(ws)).withColumn("peak", F.max("price").over(w))


CTES["exits"] = """
SELECT strategy_id, symbol, idx, ts, close AS price, reason FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, symbol, idx ORDER BY ts) AS r FROM (
  SELECT h.strategy_id, h.symbol, h.idx, c.ts, c.close, CASE
    WHEN c.close <= h.entry_price * (1.0 - stop_loss_pct / 100.0) THEN 'stop_loss'
    WHEN c.close <= greatest(h.peak, max(c.close) OVER (PARTITION BY h.strategy_id, h.symbol, h.idx ORDER BY c.ts)) * (1.0 - trailing_stop_pct / 100.0) THEN 'trailing_stop'
    WHEN c.close >= h.entry_price * (1.0 + take_profit_pct / 100.0) THEN 'take_profit' END AS reason
  FROM held h JOIN anchors_m a ON a.idx = h.idx LEFT JOIN anchors_m b ON b.idx = h.idx + 1
  JOIN candles c ON c.symbol = h.symbol AND c.ts > a.anchor AND (b.anchor IS NULL OR c.ts <= b.anchor)) WHERE reason IS NOT NULL) WHERE r = 1"""
query("first_exit", SP + "symbol:s idx:i ts:d price:f8 reason:s", "SELECT * FROM exits")(
    lambda ws: J.first_exit(open_positions(ws), ws.candles, cal(ws))
)
query(
    "first_exit_days",
    SP + "symbol:s idx:i n:i",
    """SELECT h.strategy_id, h.symbol, h.idx, count(*) AS n FROM held h JOIN anchors_m a ON a.idx = h.idx LEFT JOIN anchors_m b ON b.idx = h.idx + 1
    JOIN candles c ON c.symbol = h.symbol AND c.ts > a.anchor AND (b.anchor IS NULL OR c.ts <= b.anchor) GROUP BY 1, 2, 3""",
)(
    lambda ws: members(ws).join(
        ws.candles.select("symbol", J.period_index(cal(ws), F.col("ts")).alias("idx")), ["symbol", "idx"]
    ).groupBy("strategy_id", "symbol", "idx").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "exit_levels",
    SP + "symbol:s idx:i pnl:f4 stop_price:f6 trailing_stop_price:f6 take_profit_price:f6",
    """SELECT strategy_id, symbol, idx, round(price / entry_price - 1.0, 4) AS pnl, round(entry_price * (1.0 - stop_loss_pct / 100.0), 8) AS stop_price,
      round(peak * (1.0 - trailing_stop_pct / 100.0), 8) AS trailing_stop_price, round(entry_price * (1.0 + take_profit_pct / 100.0), 8) AS take_profit_price FROM held""",
)(
    lambda ws: J.exit_levels(
        open_positions(ws).withColumn("direction", F.lit("long")).withColumn("price_now", F.col("price"))
    )
)
query(
    "in_btc_reason",
    SP + "idx:i in_btc:s",
    """SELECT s.strategy_id, a.idx, CASE WHEN coalesce(n.g, 0) <= 1e-9 THEN CASE WHEN s.ic_filter AND NOT coalesce(t.ic_risk_on, TRUE) THEN 'ic'
      WHEN NOT coalesce(r.risk_on, TRUE) AND s.regime_exposure <= 0 THEN 'regime' ELSE 'cash' END END AS in_btc
    FROM strats s CROSS JOIN anchors_m a LEFT JOIN (SELECT strategy_id, idx, sum(abs(weight)) AS g FROM book GROUP BY 1, 2) n ON n.strategy_id = s.strategy_id AND n.idx = a.idx
    LEFT JOIN risk r ON r.strategy_id = s.strategy_id AND r.idx = a.idx LEFT JOIN timing t ON t.strategy_id = s.strategy_id AND t.anchor = a.anchor
    WHERE a.idx < (SELECT li FROM lastidx)""",
)(lambda ws: J.period_flags(book(ws), strats(ws), regime(ws), ws.panel(), cal(ws)))
query(
    "book_state",
    SP + "symbol:s direction:s weight:f6 entry_anchor:d entry_price:f8 last_price:f8 peak:f8 periods_held:i keep:f6",
    """SELECT strategy_id, symbol, direction, round(weight, 6) AS weight, entry_anchor, entry_price, price AS last_price, peak, held AS periods_held, 1.0 AS keep FROM (
      SELECT *, row_number() OVER w - 1 AS held, first_value(anchor) OVER w AS entry_anchor, first_value(price) OVER w AS entry_price, max(price) OVER w AS peak FROM (
        SELECT *, idx - row_number() OVER (PARTITION BY strategy_id, symbol, direction ORDER BY idx) AS g FROM book WHERE idx < (SELECT li FROM lastidx))
      WINDOW w AS (PARTITION BY strategy_id, symbol, direction, g ORDER BY idx)) WHERE idx = (SELECT li FROM lastidx) - 1""",
)(lambda ws: J.book_state(book(ws), ws.panel(), cal(ws)))
query(
    "book_summary",
    SP + "anchor:d equity:l8 long_notional:f6 short_notional:f6 risk_on:b ic_risk_on:b rolling_ic:f6",
    """SELECT s.strategy_id, a.anchor, e.equity, coalesce(n.ln, 0) AS long_notional, coalesce(n.sn, 0) AS short_notional, coalesce(r.risk_on, TRUE) AS risk_on,
      coalesce(t.ic_risk_on, TRUE) AS ic_risk_on, t.rolling_ic FROM strats s JOIN anchors_m a ON a.idx = (SELECT li FROM lastidx) - 1
    LEFT JOIN (SELECT strategy_id, sum(weight) FILTER (weight > 0) AS ln, -sum(weight) FILTER (weight < 0) AS sn FROM book WHERE idx = (SELECT li FROM lastidx) - 1 GROUP BY 1) n USING (strategy_id)
    LEFT JOIN (SELECT strategy_id, max_by(equity, idx) AS equity FROM curve GROUP BY 1) e USING (strategy_id)
    LEFT JOIN risk r ON r.strategy_id = s.strategy_id AND r.idx = a.idx LEFT JOIN timing t ON t.strategy_id = s.strategy_id AND t.anchor = a.anchor""",
)(lambda ws: J.book_summary(book(ws), curve(ws), strats(ws), regime(ws), ws.panel(), cal(ws)))
# Recursion over the periods: equity, its last values, the lock level and the weights held, as a map from symbol.
CTES["overlay_rows"] = """
SELECT p.strategy_id, p.idx, p.funding, p.fee_pct, coalesce(g.lr, 0) AS lr, coalesce(g.sr, 0) AS sr,
  coalesce(b.longs, map([]::VARCHAR[], []::DOUBLE[])) AS longs, coalesce(b.shorts, map([]::VARCHAR[], []::DOUBLE[])) AS shorts
FROM per p LEFT JOIN (SELECT strategy_id, idx, sum(CASE WHEN direction = 'long' THEN weight * ret ELSE 0 END) AS lr,
    sum(CASE WHEN direction = 'short' THEN weight * ret ELSE 0 END) AS sr FROM posret GROUP BY 1, 2) g USING (strategy_id, idx)
LEFT JOIN (SELECT strategy_id, idx, map_from_entries(list((symbol, weight)) FILTER (direction = 'long')) AS longs,
    map_from_entries(list((symbol, weight)) FILTER (direction = 'short')) AS shorts FROM book GROUP BY 1, 2) b USING (strategy_id, idx)"""
CTES["overlays"] = """
WITH RECURSIVE w AS (
  SELECT strategy_id, -1 AS idx, 1.0::DOUBLE AS equity, []::DOUBLE[] AS recent, 1.0::DOUBLE AS lock_at, map([]::VARCHAR[], []::DOUBLE[]) AS held,
    1.0::DOUBLE AS scale, FALSE AS brake, 0.0::DOUBLE AS net FROM (SELECT DISTINCT strategy_id FROM overlay_rows)
  UNION ALL
  SELECT strategy_id, n, equity * (1 + net), recent, lock_at, now, scale, brake, net FROM (
    SELECT *, lr * scale + sr - list_sum(list_transform(list_distinct(list_concat([''], map_keys(now), map_keys(held))),
        lambda k: abs(coalesce(now[k], 0) - coalesce(held[k], 0)))) * fee_pct / 100.0 - funding AS net FROM (
      SELECT *, map_from_entries(list_concat(list_transform(map_entries(longs), lambda e: (e.key, e.value * scale)), list_transform(map_entries(shorts), lambda e: (e.key, e.value)))) AS now,
        CASE WHEN locks THEN equity ELSE lock_old END AS lock_at FROM (
        SELECT *, CASE WHEN brake THEN 0.35 ELSE 1.0 END * CASE WHEN locks THEN 0.75 ELSE 1.0 END AS scale FROM (
          SELECT *, busy AND len(recent) >= 3 AND equity < list_avg(recent) AS brake, busy AND equity >= lock_old * 2 AS locks FROM (
            SELECT r.*, w.idx + 1 AS n, w.equity, w.held, w.lock_at AS lock_old, list_append(w.recent, w.equity)[-6:] AS recent, cardinality(r.longs) > 0 AS busy
            FROM w JOIN overlay_rows r ON r.strategy_id = w.strategy_id AND r.idx = w.idx + 1))))))
SELECT * FROM w WHERE idx >= 0"""
query("equity_overlays", SP + "idx:i scale:f6 brake:b period_return:f8 equity:l8", "SELECT *, net AS period_return FROM overlays")(
    lambda ws: J.equity_overlays(
        book(ws), periods(ws), ws.panel(),
        strats(ws).withColumns({"equity_trend_exposure": F.lit(0.35), "profit_lock_pct": F.lit(25.0)}), cal(ws),
    )
)
query(
    "sink_curve_csv",
    "strategy_id:s date:s equity:l6 equity_usd:l6 benchmark_usd:f5 period_return:f5",
    """SELECT strategy_id, anchor AS date, round(equity, 6) AS equity, round(equity_usd, 6) AS equity_usd,
      round(benchmark_usd, 6) AS benchmark_usd, round(period_return, 6) AS period_return FROM curve""",
)(lambda ws: _curve_csv(ws))


def _curve_csv(ws):
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.sinks import write_curve_csv

    path = f"{shared_dir(ws.spark)}/curve-csv-{uuid.uuid4().hex}"
    write_curve_csv(curve(ws), path)
    values = "date string, equity double, equity_usd double, benchmark_usd double, period_return double"
    return ws.spark.read.option("header", True).schema(f"{values}, strategy_id string").csv(path)


