"""Validation, signal, alert and streaming queries (sections L, M, N and the rest of F and G)."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlbase import CTES
from catalog.strategies import _LIQ, CONFIGS, M, _literal, book, cal, curve, regime, strats, trades
from tidemark.operators import signals as S
from tidemark.operators import strategy as J
from tidemark.operators import sweep as L
from tidemark.operators.series import dip_history
from tidemark.plans.presets import DEFAULTS, strategies
from tidemark.plans import space
from tidemark.plans.space import DEFAULT_SEARCH, sample_strategies
from tidemark.session import materialize, shared_dir
from tidemark.sources.store import ChangeLog
from tidemark.streaming import jobs

EVENT = dt.date(1998, 1, 1)
SP = "strategy_id:s "


def split(ws):
    return L.split_anchors(cal(ws).frame(ws.spark), 0.3)


def folds(ws):
    return L.cv_folds(split(ws), 3)


CTES["split"] = """
SELECT anchor, idx, n - greatest(2, CAST(round_even(n * 0.3, 0) AS INTEGER)) AS n_train,
  idx >= n - greatest(2, CAST(round_even(n * 0.3, 0) AS INTEGER)) AS is_holdout FROM anchors_m, (SELECT count(*) AS n FROM anchors_m)"""
CTES["folds"] = """
SELECT fold, 0 AS train_start, tail + fold * size - 2 AS train_end, tail + fold * size AS test_start,
  CASE WHEN fold = 2 THEN n ELSE tail + (fold + 1) * size END AS test_end, 1 AS embargo
FROM (SELECT n, tail, (n - tail) // 3 AS size, unnest([0, 1, 2]) AS fold FROM (
  SELECT max(n_train) AS n, greatest(3, max(n_train) // 3) + 2 AS tail FROM split))"""
CTES["slices"] = """
SELECT 'train' AS slice, 0 AS a, max(n_train) - 1 AS b FROM split UNION ALL SELECT 'holdout', max(n_train), max(idx) FROM split
UNION ALL SELECT 'fold' || fold, test_start, test_end - 1 FROM folds"""
CTES["sliced"] = """
SELECT c.strategy_id, s.slice, c.idx, c.anchor, c.equity, c.period_return,
  row_number() OVER w - 1 AS k, max(c.equity) OVER w AS peak, count(*) OVER (PARTITION BY strategy_id, slice) - 1 AS n
FROM curve c JOIN slices s ON c.idx BETWEEN s.a AND s.b WINDOW w AS (PARTITION BY strategy_id, slice ORDER BY c.idx)"""
CTES["slice_metrics"] = """
WITH b AS (SELECT strategy_id, slice, min_by(equity, idx) AS e0, max_by(equity, idx) AS e1, avg(period_return) FILTER (k > 0) AS m,
  coalesce(stddev_samp(period_return) FILTER (k > 0), 0) AS s, avg(CASE WHEN period_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (k > 0) AS win_rate,
  least(0, min(equity / peak - 1)) AS max_drawdown, max(anchor) - min(anchor) AS days, count(*) - 1 AS periods,
  avg(CASE WHEN equity < peak - 1e-12 THEN 1.0 ELSE 0.0 END) AS time_in_drawdown FROM sliced GROUP BY 1, 2),
r AS (SELECT x.strategy_id, x.slice, avg(CASE WHEN x.equity / y.equity > 1 THEN 1.0 ELSE 0.0 END) AS positive_rolling_share
  FROM sliced x JOIN sliced y ON y.strategy_id = x.strategy_id AND y.slice = x.slice AND x.k = y.k + least(least(12, greatest(2, y.n // 3)), y.n) GROUP BY 1, 2)
SELECT b.*, e1 / e0 - 1 AS total_return, CASE WHEN e1 / e0 > 0 THEN pow(e1 / e0, 1.0 / (days / 365.0)) - 1 ELSE -1 END AS cagr,
  s * sqrt(365.0 / 30) AS volatility, CASE WHEN s > 0 THEN m / s * sqrt(365.0 / 30) ELSE 0 END AS sharpe,
  CASE WHEN max_drawdown < 0 THEN (CASE WHEN e1 / e0 > 0 THEN pow(e1 / e0, 1.0 / (days / 365.0)) - 1 ELSE -1 END) / abs(max_drawdown) END AS calmar,
  coalesce(r.positive_rolling_share, 0) AS positive_rolling_share
FROM b LEFT JOIN r USING (strategy_id, slice)"""


def slice_metrics(ws):
    return ws.keep("slice_metrics", lambda: L.slice_metrics(curve(ws), L.slices(split(ws), folds(ws)), M))


query("train_holdout_split", "anchor:d idx:i n_train:i is_holdout:b", "SELECT * FROM split")(split)
query("cv_folds", "fold:i train_start:i train_end:i test_start:i test_end:i embargo:i", "SELECT * FROM folds")(folds)
query(
    "slice_metrics",
    SP + "slice:s total_return:l8 cagr:l8 volatility:l8 sharpe:f6 max_drawdown:f6 calmar:l8 win_rate:f6 periods:i "
    "positive_rolling_share:f6 time_in_drawdown:f6",
    "SELECT * FROM slice_metrics",
)(slice_metrics)
query("objective", SP + "slice:s objective:f3", "SELECT *, round(sharpe, 3) AS objective FROM slice_metrics")(
    lambda ws: L.objective(slice_metrics(ws), "sharpe")
)
query(
    "objective_consistency", SP + "slice:s objective:f4", "SELECT *, round(positive_rolling_share, 4) AS objective FROM slice_metrics"
)(lambda ws: L.objective(slice_metrics(ws), "consistency"))
CTES["cv"] = """
SELECT strategy_id, round(avg(round(sharpe, 3)), 4) AS cv_mean, round(min(round(sharpe, 3)), 4) AS cv_min FROM slice_metrics
WHERE slice LIKE 'fold%' GROUP BY 1"""
query("cv_score", SP + "cv_mean:f3 cv_min:f3", "SELECT * FROM cv")(
    lambda ws: L.cv_score(L.objective(slice_metrics(ws), "sharpe"))
)
query(
    "cv_score_limited",
    SP + "cv_min:f3",
    "SELECT cv.* FROM cv JOIN (SELECT strategy_id, min(max_drawdown) AS w FROM slice_metrics WHERE slice LIKE 'fold%' GROUP BY 1) USING (strategy_id) WHERE round(w, 4) >= -0.3",
)(lambda ws: L.cv_score(L.objective(slice_metrics(ws), "sharpe"), 30.0))
CTES["verdicts"] = """
SELECT cv.*, h.hr AS holdout_return, h.hs AS holdout_score, CASE WHEN h.hs IS NULL THEN 'missing validation data' WHEN cv_mean <= 0 THEN 'CV mean not positive'
  WHEN cv_min <= 0 THEN 'a walk-forward fold lost' WHEN hr <= 0 THEN 'holdout loses money' WHEN hs <= 0 THEN 'holdout not positive'
  WHEN hs < 0.5 * cv_mean THEN 'holdout keeps less than the required share of the CV edge' END AS reason
FROM cv LEFT JOIN (SELECT strategy_id, round(total_return, 4) AS hr, round(sharpe, 3) AS hs FROM slice_metrics WHERE slice = 'holdout') h USING (strategy_id)"""


def verdicts(ws):
    scored = L.objective(slice_metrics(ws), "sharpe")
    return L.holdout_gate(L.cv_score(scored), scored, "strict")


query("holdout_gate", SP + "passed:b reason:s", "SELECT *, reason IS NULL AS passed FROM verdicts")(verdicts)
query(
    "rejection_reasons", "reason:s n:i", "SELECT reason, count(*) AS n FROM verdicts WHERE reason IS NOT NULL GROUP BY 1"
)(lambda ws: L.rejection_reasons(verdicts(ws)))
query(
    "sweep_report",
    SP + "cv_mean:f3 cv_min:f3 passed:b reason:s",
    """SELECT *, reason IS NULL AS passed FROM (SELECT *, row_number() OVER (PARTITION BY cv_mean, cv_min, round(holdout_return, 3) ORDER BY strategy_id) AS c FROM verdicts)
    WHERE c = 1 ORDER BY (reason IS NULL) DESC, cv_mean DESC, cv_min DESC, strategy_id LIMIT 5""",
)(lambda ws: L.sweep_report(verdicts(ws)))
query(
    "sweep_provenance",
    "slice:s first_anchor:d last_anchor:d anchors:i",
    """SELECT s.slice, x.anchor AS first_anchor, y.anchor AS last_anchor, s.b - s.a + 1 AS anchors
    FROM (SELECT * FROM slices UNION ALL SELECT 'train' || fold, train_start, train_end - 1 FROM folds) s
    JOIN anchors_m x ON x.idx = s.a JOIN anchors_m y ON y.idx = s.b""",
)(lambda ws: L.provenance(split(ws), folds(ws)))


def sampled(ws):
    """A sweep of sampled set-wise strategies: every trial is a row of one job."""
    trials = materialize(
        sample_strategies(ws.spark, list(DEFAULT_SEARCH), 200, 7, M), "trials"
    )
    held = materialize(J.book(ws.panel(), regime(ws), trials, cal(ws)), "trial-book")
    rows = materialize(J.periods(held, ws.panel(), trials, cal(ws)), "trial-periods")
    metrics = materialize(L.slice_metrics(J.equity_curve(rows), L.slices(split(ws), folds(ws)), M), "trial-metrics")
    scored = L.objective(metrics, "sharpe")
    return L.sweep_report(L.holdout_gate(L.cv_score(scored), scored, "balanced"))




def _trials_sql(trials: int, seed: int) -> str:
    """The sampled configurations, by the same permutation of their numbers."""
    first, rest = space._halves(list(DEFAULT_SEARCH))
    a, b = (math.prod(len(space.choices(n)) for n in part) for part in (first, rest))
    draw = lambda turn, v, size: f"(('0x' || substr(md5('{seed}:{turn}:' || CAST({v} AS VARCHAR)), 1, 8))::BIGINT % {size})"
    sql = f"SELECT t, t % {a} AS x, t // {a} AS y FROM range({trials}) r(t)"
    for turn in range(space.TURNS):
        sql = f"SELECT t, (x + {draw(2 * turn, 'y', a)}) % {a} AS x, y FROM ({sql})"
        sql = f"SELECT t, x, (y + {draw(2 * turn + 1, 'x', b)}) % {b} AS y FROM ({sql})"
    digits = {}
    for part, column in ((first, "x"), (rest, "y")):
        for name in part:
            digits[name] = f"{column} % {len(space.choices(name))}"
            column = f"({column} // {len(space.choices(name))})"
    cells = ["'trial-' || lpad(CAST(t AS VARCHAR), 6, '0') AS strategy_id"]
    for name, (kind, default) in DEFAULTS.items():
        if name in digits:
            options = ", ".join(_literal(v, kind) for v in space.choices(name))
            cells.append(f"([{options}])[CAST({digits[name]} AS INTEGER) + 1] AS {name}")
        else:
            cells.append(f"{_literal(M if name == 'frequency' else default, kind)} AS {name}")
    return f"SELECT {', '.join(cells)} FROM ({sql})"


# The chain of the fixed strategies once more, for the sampled ones: same statements over other strategies.
_CHAIN = ["strats", "cand", "picks", "weighted", "risk", "gated", "short_rows", "timing", "book", "posret", "traded", "per", "curve", "sliced", "slice_metrics", "cv", "verdicts"]
_WORD = re.compile(r"\b(" + "|".join(_CHAIN) + r")\b")
CTES["trial_strats"] = _trials_sql(200, 7)
CTES["trial_hold"] = f"""
SELECT s.*, p.anchor, p.idx, p.symbol, p.score, p.distance, p.price, p.cap, p.volume, p.score >= coalesce(sell_score, min_score) AS stay,
  p.score >= min_score AND {_LIQ} AND (min_trend_30d IS NULL OR coalesce(trend_30d >= min_trend_30d, FALSE)) AS enter
FROM panel_m p CROSS JOIN trial_strats s WHERE rotation = 'hold'"""
CTES["trial_members"] = CTES["members"].replace("hold_rows", "trial_hold")
for _name in _CHAIN[1:]:
    CTES[f"trial_{_name}"] = _WORD.sub(r"trial_\1", CTES[_name])
CTES["trial_picks"] += """ AND rotation <> 'hold'
UNION ALL BY NAME SELECT * EXCLUDE (stay, enter), NULL AS place FROM trial_members"""
CTES["trial_weighted"] = CTES["trial_weighted"].replace("count(*) OVER w / top_n AS filled", "least(count(*) OVER w / top_n, 1) AS filled")
CTES["trial_verdicts"] = CTES["trial_verdicts"].replace("WHEN cv_min <= 0 THEN 'a walk-forward fold lost' ", "").replace("0.5 * cv_mean", "0.25 * cv_mean")
query(
    "sampled_sweep",
    SP + "cv_mean:f3 cv_min:f3 holdout_score:f3 passed:b reason:s",
    """SELECT *, reason IS NULL AS passed FROM (SELECT *, row_number() OVER (PARTITION BY cv_mean, cv_min, round(holdout_return, 3) ORDER BY strategy_id) AS c FROM trial_verdicts)
    WHERE c = 1 ORDER BY (reason IS NULL) DESC, cv_mean DESC, cv_min DESC, strategy_id LIMIT 5""",
)(sampled)

# --- signals -------------------------------------------------------------------------------------
CTES["signal_log"] = """
SELECT strategy_id AS watch_id, entry_anchor AS date, 'BUY' AS action, symbol, CAST(NULL AS VARCHAR) AS reason FROM trade_rows
UNION ALL SELECT strategy_id, exit_anchor, 'SELL', symbol, reason FROM trade_rows WHERE reason <> 'open'"""


def signal_log(ws):
    cols = ["action", "symbol", "reason"]
    buys = trades(ws).select(F.col("strategy_id").alias("watch_id"), F.col("entry_anchor").alias("date"), F.lit("BUY").alias("action"), "symbol", F.lit(None).cast("string").alias("reason"))
    sells = trades(ws).filter("reason <> 'open'").select(F.col("strategy_id").alias("watch_id"), F.col("exit_anchor").alias("date"), F.lit("SELL").alias("action"), *cols[1:])
    return buys.unionByName(sells)


def levelled(ws):
    return strats(ws).withColumns({"stop_loss_pct": F.lit(20.0), "trailing_stop_pct": F.lit(40.0), "take_profit_pct": F.lit(500.0)})


def live(ws):
    return ws.keep("live", lambda: S.live_positions(book(ws), ws.panel(), ws.candles, levelled(ws), cal(ws), ws.last_day))


def flat(ws):
    flags = J.period_flags(book(ws), strats(ws), regime(ws), ws.panel(), cal(ws))
    last = cal(ws).frame(ws.spark).agg(F.max("idx")).select("max(idx)").scalar()
    return flags.filter(F.col("idx") == last - 1).select("strategy_id", "in_btc")


CTES["open_state"] = """
SELECT strategy_id, symbol, direction, round(weight, 6) AS weight, score, entry_anchor, entry_price, price AS last_price, peak, held AS periods_held FROM (
  SELECT *, row_number() OVER w - 1 AS held, first_value(anchor) OVER w AS entry_anchor, first_value(price) OVER w AS entry_price, max(price) OVER w AS peak FROM (
    SELECT *, idx - row_number() OVER (PARTITION BY strategy_id, symbol, direction ORDER BY idx) AS g FROM book WHERE idx < (SELECT li FROM lastidx))
  WINDOW w AS (PARTITION BY strategy_id, symbol, direction, g ORDER BY idx)) WHERE idx = (SELECT li FROM lastidx) - 1
QUALIFY sum(abs(weight)) OVER (PARTITION BY strategy_id) > 1e-9"""
# Peak of a long over its anchors and the daily closes since its entry, up to the last anchor and up to the end.
CTES["tops"] = """
SELECT s.strategy_id, s.symbol, s.direction, max(c.close) FILTER (c.ts <= (SELECT max(anchor) FROM anchors_m)) AS before, max(c.close) AS now
FROM open_state s JOIN candles c ON c.symbol = s.symbol AND c.ts > s.entry_anchor WHERE s.direction = 'long' GROUP BY 1, 2, 3"""
CTES["state"] = """
SELECT s.* REPLACE (greatest(s.peak, coalesce(t.before, s.peak)) AS peak), t.now AS top_now FROM open_state s LEFT JOIN tops t USING (strategy_id, symbol, direction)"""
CTES["fired"] = """
SELECT strategy_id, symbol, direction, arg_min(ts, ts) AS trigger_date, arg_min(close, ts) AS trigger_price, arg_min(reason, ts) AS reason, arg_min(run_peak, ts) AS run_peak FROM (SELECT *, CASE WHEN close <= entry_price * (1.0 - 20.0 / 100.0) THEN 'stop_loss'
    WHEN close <= run_peak * (1.0 - 40.0 / 100.0) THEN 'trailing_stop' WHEN close >= entry_price * (1.0 + 500.0 / 100.0) THEN 'take_profit' END AS reason FROM (
  SELECT s.strategy_id, s.symbol, s.direction, c.ts, c.close, s.entry_price, greatest(peak, max(c.close) OVER (PARTITION BY s.strategy_id, s.symbol ORDER BY c.ts)) AS run_peak
  FROM state s JOIN candles c ON c.symbol = s.symbol AND c.ts > (SELECT max(anchor) FROM anchors_m) WHERE direction = 'long')) WHERE reason IS NOT NULL GROUP BY 1, 2, 3"""
CTES["live_book"] = """
SELECT s.*, n.close AS price_now, f.trigger_date, f.trigger_price, f.reason, CASE WHEN f.reason IS NOT NULL THEN 'SELL' ELSE 'HOLD' END AS action,
  CASE WHEN direction = 'long' THEN coalesce(p.score, s.score) ELSE p.score END AS live_score,
  round(CASE WHEN direction = 'short' THEN entry_price / n.close - 1.0 ELSE n.close / entry_price - 1.0 END, 4) AS pnl,
  CASE WHEN direction = 'long' THEN round(entry_price * (1.0 - 20.0 / 100.0), 8) END AS stop_price,
  CASE WHEN direction = 'long' THEN coalesce(f.run_peak, greatest(s.peak, coalesce(s.top_now, s.peak))) END AS live_peak,
  round(live_peak * (1.0 - 40.0 / 100.0), 8) AS trailing_stop_price, CASE WHEN direction = 'long' THEN round(entry_price * (1.0 + 500.0 / 100.0), 8) END AS take_profit_price
FROM state s JOIN (SELECT symbol, max_by(close, ts) AS close FROM candles GROUP BY 1) n USING (symbol)
LEFT JOIN fired f USING (strategy_id, symbol, direction)
LEFT JOIN (SELECT symbol, score FROM panel_m WHERE idx = (SELECT li FROM lastidx)) p USING (symbol)"""
query(
    "live_signals",
    SP + "symbol:s direction:s weight:f6 entry_anchor:d entry_price:f8 price_now:f8 pnl:f4 peak:f6 stop_price:f6 trailing_stop_price:f6 take_profit_price:f6 action:s reason:s "
    "trigger_date:d trigger_price:f8 live_score:f1 periods_held:i",
    "SELECT * REPLACE (live_peak AS peak) FROM live_book",
)(live)


def signal_rows(ws):
    end = cal(ws).frame(ws.spark).agg(F.max("anchor")).first()[0]
    equity = curve(ws).groupBy("strategy_id").agg(F.max_by("equity", "idx").alias("equity"))
    return S.signal_rows(live(ws), flat(ws), end, equity)


query(
    "signal_rows",
    "watch_id:s date:d action:s symbol:s reason:s message:s price:f8 score:f1 equity:l8",
    """WITH flat AS (SELECT s.strategy_id FROM strats s WHERE coalesce((SELECT sum(abs(weight)) FROM book b WHERE b.strategy_id = s.strategy_id AND b.idx = (SELECT li FROM lastidx) - 1), 0) <= 1e-9),
    a AS (SELECT max(anchor) AS la FROM anchors_m), e AS (SELECT strategy_id, max_by(equity, idx) AS equity FROM curve GROUP BY 1)
    SELECT strategy_id AS watch_id, CASE WHEN action = 'SELL' THEN trigger_date ELSE la END AS date,
      CASE WHEN action = 'SELL' THEN 'SELL' WHEN entry_anchor = la THEN CASE WHEN direction = 'long' THEN 'BUY' ELSE 'SHORT' END ELSE 'HOLD' END AS action,
      symbol, reason, CAST(NULL AS VARCHAR) AS message, CASE WHEN action = 'SELL' THEN trigger_price ELSE entry_price END AS price, live_score AS score, equity
    FROM live_book JOIN e USING (strategy_id), a WHERE strategy_id NOT IN (SELECT strategy_id FROM flat)
    UNION ALL SELECT f.strategy_id, la, 'STAY_IN_BTC', '', 'cash', 'no positions: no candidate passed the strategy''s filters', NULL, NULL, equity FROM flat f JOIN e USING (strategy_id), a""",
)(signal_rows)
query(
    "append_new_signals",
    "watch_id:s date:d action:s symbol:s",
    "SELECT * FROM signal_log WHERE NOT (date < DATE '2000-01-01' AND action = 'BUY')",
)(lambda ws: S.append_new(signal_log(ws), signal_log(ws).filter("date < '2000-01-01' and action = 'BUY'")))
query(
    "return_since",
    "watch_id:s date:d action:s symbol:s return_since:l8",
    """SELECT s.*, n.e / b.equity - 1.0 AS return_since FROM signal_log s JOIN curve b ON b.strategy_id = s.watch_id AND b.anchor = s.date
    JOIN (SELECT strategy_id, max_by(equity, idx) AS e FROM curve GROUP BY 1) n ON n.strategy_id = s.watch_id""",
)(lambda ws: S.return_since(signal_log(ws), curve(ws)))
query(
    "paper_return",
    "watch_id:s start_equity:l8 last_equity:l8 paper_return:l8",
    """SELECT w.strategy_id AS watch_id, b.e AS start_equity, n.e AS last_equity, n.e / b.e - 1.0 AS paper_return FROM strats w
    JOIN (SELECT strategy_id, max_by(equity, idx) AS e FROM curve WHERE anchor <= DATE '2000-03-15' GROUP BY 1) b USING (strategy_id)
    JOIN (SELECT strategy_id, max_by(equity, idx) AS e FROM curve GROUP BY 1) n USING (strategy_id)""",
)(
    lambda ws: S.paper_return(
        strats(ws).select(F.col("strategy_id").alias("watch_id"), F.lit(dt.date(2000, 3, 15)).alias("created_at")), curve(ws)
    )
)
query(
    "actionable_signals",
    "watch_id:s date:d action:s symbol:s message:s",
    """SELECT *, '[' || watch_id || '] ' || CASE action WHEN 'BUY' THEN 'buy' ELSE 'sell' END || ' ' || symbol
      || CASE WHEN reason IS NOT NULL THEN ' (' || reason || ')' ELSE '' END || ' · anchor ' || CAST(date AS VARCHAR) AS message FROM signal_log""",
)(lambda ws: S.actionable(signal_log(ws)))
query(
    "signal_history",
    "watch_id:s date:d action:s symbol:s place:i",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY date DESC, action, symbol) AS place FROM signal_log) WHERE place <= 50",
)(lambda ws: S.signal_history(signal_log(ws), 50))
query(
    "next_candidates",
    SP + "symbol:s score:f1 place:i",
    """SELECT * FROM (SELECT s.strategy_id, s.top_n, p.symbol, p.score, row_number() OVER (PARTITION BY strategy_id ORDER BY CASE WHEN invert_score THEN -p.score ELSE p.score END DESC, p.symbol) AS place
      FROM panel_m p CROSS JOIN strats s WHERE p.idx = (SELECT li FROM lastidx)
        AND NOT EXISTS (SELECT 1 FROM state t WHERE t.strategy_id = s.strategy_id AND t.symbol = p.symbol)) WHERE place <= top_n""",
)(lambda ws: S.next_candidates(ws.panel(), live(ws), strats(ws), cal(ws)))
query(
    "held_difference",
    SP + "symbol:s",
    """SELECT s.strategy_id, p.symbol FROM panel_m p CROSS JOIN strats s WHERE p.idx = (SELECT li FROM lastidx)
    EXCEPT SELECT strategy_id, symbol FROM state""",
)(lambda ws: S.held_difference(ws.panel(), live(ws), strats(ws), cal(ws)))
query("tracked_symbols", "symbol:s", "SELECT DISTINCT symbol FROM state")(lambda ws: S.tracked_symbols(live(ws)))
CTES["watched_distance"] = """
SELECT d.symbol, d.ts, d.distance_event AS distance, coalesce(w.threshold_pct, 2000.0) AS threshold,
  lag(d.distance_event) OVER (PARTITION BY d.symbol ORDER BY d.ts) AS previous FROM dip d JOIN watchlist w USING (symbol)"""
ALERT_SQL = "SELECT * FROM watched_distance WHERE (previous IS NULL OR previous > threshold) AND distance <= threshold"


def distances(ws):
    return dip_history(ws.candles, EVENT).select("symbol", "ts", F.col("distance_event").alias("distance"))


query("threshold_alerts", "symbol:s ts:d distance:f5 threshold:f1", ALERT_SQL)(
    lambda ws: S.threshold_alerts(distances(ws), ws.watchlist, 2000.0)
)
# Saved strategies: the good ones, and one for each way a saved strategy can be broken.
BROKEN = {
    "no_json": ("{top_n: ", "not a JSON object"),
    "unknown": ('{"leverage": 3, "top_n": 2}', "unknown parameter: leverage"),
    "wrong_type": ('{"top_n": "many", "min_score": "high"}', "wrong type: top_n, min_score"),
    "wrong_word": ('{"weighting": "random"}', "illegal value: weighting"),
    "no_slots": ('{"top_n": 0}', "illegal value: top_n"),
    "refused": ('{"profit_lock_pct": 25, "stop_loss_pct": 10}', "rule the book does not apply: profit_lock_pct, stop_loss_pct"),
}


def saved(ws):
    rows = [(k, json.dumps(v)) for k, v in CONFIGS.items()] + [(k, text) for k, (text, _) in BROKEN.items()]
    return ws.spark.createDataFrame(rows, "strategy_id string, params string")


def refreshed(ws):
    """The log already holds the rows of one strategy and all holdings of another; what is new is written and counted."""
    run = lambda stored: S.refresh_all(saved(ws), ws.panel(), regime(ws), ws.candles, cal(ws), stored, ws.last_day)
    everything = run(signal_log(ws).filter("false"))[0]
    known = everything.filter("watch_id = 'equal' or (watch_id = 'by_score' and action = 'HOLD')")
    return run(known)[1]


query(
    "watch_refresh_all",
    "watch_id:s signals:i error:s",
    """WITH now AS (
      SELECT strategy_id AS watch_id, CASE WHEN entry_anchor = (SELECT max(anchor) FROM anchors_m) THEN CASE WHEN direction = 'long' THEN 'BUY' ELSE 'SHORT' END ELSE 'HOLD' END AS action, symbol FROM state
      UNION ALL SELECT strategy_id, 'STAY_IN_BTC', '' FROM strats s WHERE coalesce((SELECT sum(abs(weight)) FROM book b
        WHERE b.strategy_id = s.strategy_id AND b.idx = (SELECT li FROM lastidx) - 1), 0) <= 1e-9),
    new AS (SELECT * FROM now WHERE watch_id <> 'equal' AND NOT (watch_id = 'by_score' AND action = 'HOLD'))
    SELECT strategy_id AS watch_id, (SELECT count(*) FROM new n WHERE n.watch_id = s.strategy_id) AS signals, CAST(NULL AS VARCHAR) AS error FROM strats s
    UNION ALL SELECT watch_id, 0, error FROM (VALUES """
    + ", ".join(f"('{k}', '{e}')" for k, (_, e) in BROKEN.items())
    + ") broken(watch_id, error)",
)(refreshed)
query(
    "watchlist_edit",
    "symbol:s threshold_pct:f2 created_at:d",
    """SELECT symbol, CASE WHEN is_stable THEN 5.0 ELSE 33.0 END AS threshold_pct, CASE WHEN w.symbol IS NOT NULL THEN w.created_at ELSE DATE '2001-01-01' END AS created_at
    FROM coins c LEFT JOIN watchlist w USING (symbol) WHERE c.symbol <> 'Brand#1' AND c.market_id < 'brand-2'
    UNION ALL SELECT symbol, threshold_pct, created_at FROM watchlist WHERE symbol NOT IN (SELECT symbol FROM coins WHERE market_id < 'brand-2')""",
)(
    lambda ws: S.edit_watchlist(
        ws.watchlist,
        ws.coins.filter("market_id < 'brand-2'").select(
            "symbol", F.when(F.col("is_stable"), 5.0).otherwise(33.0).alias("threshold_pct"),
            F.lit(dt.date(2001, 1, 1)).alias("created_at"), (F.col("symbol") == "Brand#1").alias("remove"),
        ),
    )
)
CTES["edited"] = f"""
SELECT strategy_id, top_n, min_score, weighting, fee_pct, rotation, ic_window FROM strats WHERE strategy_id NOT IN ('equal', 'timed')
UNION ALL SELECT 'fresh', 7, {DEFAULTS["min_score"][1]}, '{DEFAULTS["weighting"][1]}', {DEFAULTS["fee_pct"][1]}, '{DEFAULTS["rotation"][1]}', {DEFAULTS["ic_window"][1]}"""


def edited(ws):
    """The edited table, each strategy with what the edit left of its signals."""
    kept, signals = S.edit_strategies(
        strats(ws), signal_log(ws), strategies(ws.spark, {"fresh": {"top_n": 7}}).select("strategy_id", "top_n"),
        strats(ws).filter("strategy_id in ('equal', 'timed')"),
    )
    counts = signals.groupBy(F.col("watch_id").alias("strategy_id")).agg(F.count(F.lit(1)).alias("n"))
    return kept.join(counts, "strategy_id", "full").withColumn("signals", F.coalesce("n", F.lit(0)))


query(
    "strategy_edit",
    SP + "top_n:i min_score:f4 weighting:s fee_pct:f4 rotation:s ic_window:i signals:i",
    "SELECT e.*, (SELECT count(*) FROM signal_log l WHERE l.watch_id = e.strategy_id) AS signals FROM edited e",
)(edited)


# --- streaming -----------------------------------------------------------------------------------
def _folder(ws, name: str) -> str:
    return f"{shared_dir(ws.spark)}/{name}-{uuid.uuid4().hex}"


def _arrivals(rows, ts: str, days: int, slices: int):
    """The rows dealt to `slices` landings in the order they arrive, each up to `days` late by a hash of the row."""
    delay = F.pmod(F.xxhash64(*rows.columns), F.lit(days * 86400))
    arrival = F.unix_seconds(F.col(ts).cast("timestamp")) + delay
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    step = (high - low) // slices + 1
    return [rows.filter(F.floor((arrival - low) / step) == k) for k in range(slices)]


def stream_candles(ws):
    """Trades land in five slices, up to a day and a half late and out of order; each slice is several micro-batches."""
    ticks = ws.table("events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("size"), F.col("event_id").alias("seq"),
    )
    landing, checkpoint = _folder(ws, "ticks"), _folder(ws, "checkpoint")
    log = ChangeLog(_folder(ws, "stream-candles"))
    for part in _arrivals(ticks, "ts", 1, 5):
        part.repartition(2, "seq").write.mode("append").parquet(landing)
        feed = ws.spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        # A slice spans six days and is read in any order, its rows come a day late.
        jobs.run_available(jobs.candle_stream(feed, "9 days"), log.path, checkpoint, "update", log.sink(every=3))
    return log.read(ws.spark)


query(
    "stream_candles",
    "symbol:s ts:d open:f6 high:f6 low:f6 close:f6 volume:f2",
    """SELECT event_type AS symbol, CAST(ts AS DATE) AS ts, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
      max_by(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""",
)(stream_candles)


def stream_alerts(ws):
    """Distances land in four slices, up to twenty days late and out of order; a heartbeat a year on ends the feed."""
    rows = materialize(distances(ws).withColumn("ts", F.col("ts").cast("timestamp")), "distances")
    beat = rows.groupBy().agg(F.lit("heartbeat").alias("symbol"), (F.max("ts") + F.expr("interval 366 days")).alias("ts"), F.lit(None).cast("double").alias("distance"))
    session = jobs.stateful_session(ws.spark)
    landing, path, checkpoint = (_folder(ws, name) for name in ("distances", "alerts", "checkpoint"))
    known = materialize(ws.watchlist, "watchlist")
    for part in [*_arrivals(rows, "ts", 20, 4), beat]:
        part.write.mode("append").parquet(landing)
        feed = session.readStream.schema(rows.schema).parquet(landing)
        jobs.run_available(jobs.alert_stream(feed, session.read.parquet(*known.inputFiles()), 2000.0, "21 days"), path, checkpoint)
    return ws.spark.read.schema(jobs.ALERT_SCHEMA).parquet(path).withColumn("ts", F.to_date("ts"))


query("stream_alerts", "symbol:s ts:d distance:f5 threshold:f1", ALERT_SQL)(stream_alerts)


def stream_signals(ws):
    landing = _folder(ws, "signals")
    rows = signal_log(ws).withColumn("date", F.col("date").cast("timestamp")).select(*S.SIGNAL_KEYS)
    rows.unionByName(rows).repartition(4).write.parquet(landing)
    feed = ws.spark.readStream.schema(rows.schema).parquet(landing)
    path = _folder(ws, "deduped")
    jobs.run_available(jobs.signal_stream(feed, "10000 days"), path, _folder(ws, "checkpoint"))
    return ws.spark.read.schema(rows.schema).parquet(path).withColumn("date", F.to_date("date"))


query("stream_signal_dedupe", "watch_id:s date:d action:s symbol:s", "SELECT DISTINCT watch_id, date, action, symbol FROM signal_log")(
    stream_signals
)
