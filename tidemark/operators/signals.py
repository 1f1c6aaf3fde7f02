"""Live signals, the signal log, paper returns and threshold alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import Calendar
from tidemark.operators.series import latest
from tidemark.operators.strategy import book, book_state, equity_curve, exit_levels, first_exit, period_flags, periods, refused_rules, sent
from tidemark.plans.panel import numbered
from tidemark.plans.presets import DEFAULTS
from tidemark.session import materialize
from tidemark.sources.tables import remove_keys, upsert

SIGNAL_KEYS = ["watch_id", "date", "action", "symbol"]
ACTIONABLE = ["BUY", "SELL", "SHORT", "STAY_IN_BTC"]
# Why a book is flat, and the words of an alert.
FLAT_PHRASES = {
    "ic": "the score's rolling IC is below the strategy's threshold",
    "regime": "the regime filter is risk-off",
    "equity": "the equity brake is active",
    "cash": "no candidate passed the strategy's filters",
}
ACTION_WORDS = {"BUY": "buy", "SELL": "sell", "SHORT": "short", "STAY_IN_BTC": "move to BTC"}
DEFAULT_THRESHOLD_PCT = 20.0


def live_positions(
    positions: DataFrame, panel: DataFrame, candles: DataFrame, strategies: DataFrame, calendar: Calendar, end: dt.date
) -> DataFrame:
    """Latest book per strategy with marks, levels and the exits fired since the last anchor.

    A strategy whose weights are all zero lists nothing. The trailing level counts from the peak, daily closes included.
    """
    state = book_state(positions, panel, calendar)
    gross = state.groupBy("strategy_id").agg(F.sum(F.abs("weight")).alias("gross")).filter("gross > 1e-9").select("strategy_id")
    state = state.join(gross, "strategy_id", "left_semi")
    levels = ["stop_loss_pct", "trailing_stop_pct", "take_profit_pct"]
    held = state.join(strategies.select("strategy_id", *levels), "strategy_id")
    anchors = calendar.frame(panel.sparkSession)
    last = anchors.agg(F.max("idx")).select("max(idx)").scalar()
    last_anchor = anchors.agg(F.max("anchor")).select("max(anchor)").scalar()
    keys = ["strategy_id", "symbol", "direction"]
    closes = held.filter("direction = 'long'").select(*keys, "entry_anchor").join(candles.filter(F.col("ts") <= F.lit(end)).select("symbol", "ts", "close"), "symbol")
    closes = closes.filter(F.col("ts") > F.col("entry_anchor")).groupBy(*keys).agg(
        F.max(F.when(F.col("ts") <= last_anchor, F.col("close"))).alias("top_before"), F.max("close").alias("top_now")
    )
    held = held.join(closes, keys, "left").withColumn("peak", F.greatest("peak", F.coalesce("top_before", "peak")))
    now = latest(candles, end).select("symbol", F.col("close").alias("mark"))
    pool = numbered(panel, calendar).filter(F.col("idx") == last).select("symbol", F.col("score").alias("pool_score"))
    longs = held.filter("direction = 'long'").withColumn("idx", last)
    fired = first_exit(longs, candles.filter(F.col("ts") <= F.lit(end)), calendar).select(
        "strategy_id", "symbol", F.lit("long").alias("direction"), F.col("ts").alias("trigger_date"),
        F.col("price").alias("trigger_price"), "reason", "run_peak",
    )
    rows = (
        held.join(now, "symbol", "left")
        .join(pool, "symbol", "left")
        .join(fired, ["strategy_id", "symbol", "direction"], "left")
        .withColumn("price_now", F.coalesce("mark", "last_price"))
        .withColumn("live_score", F.when(F.col("direction") == "long", F.coalesce("pool_score", "score")).otherwise(F.col("pool_score")))
        .withColumn("action", F.when(F.col("reason").isNotNull(), "SELL").otherwise("HOLD"))
        .withColumn("peak", F.when(F.col("direction") == "long", F.coalesce("run_peak", F.greatest("peak", F.coalesce("top_now", "peak")))))
    )
    return exit_levels(rows).drop("mark", "pool_score", "run_peak", "top_before", "top_now")


def flat_message() -> Column:
    """Why a book holds nothing, in words."""
    phrase = F.lit(None).cast("string")
    for code, words in FLAT_PHRASES.items():
        phrase = F.when(F.col("in_btc") == code, f"no positions: {words}").otherwise(phrase)
    return phrase


def signal_rows(live: DataFrame, flat: DataFrame, anchor: dt.date, equity: DataFrame) -> DataFrame:
    """Storage rows of the live book: BUY or SHORT when entered now, HOLD, SELL, or one flat row.

    ``flat`` has strategy_id and in_btc of the last period; ``equity`` strategy_id and equity.
    """
    flat_now = flat.filter(F.col("in_btc").isNotNull()).select("strategy_id", "in_btc")
    new = F.col("entry_anchor") == F.lit(anchor)
    entered = F.when(F.col("direction") == "long", "BUY").otherwise("SHORT")
    sold = F.col("action") == "SELL"
    rows = live.join(flat_now, "strategy_id", "left_anti").select(
        F.col("strategy_id").alias("watch_id"),
        F.when(sold, F.col("trigger_date")).otherwise(F.lit(anchor)).alias("date"),
        F.when(sold, "SELL").when(new, entered).otherwise("HOLD").alias("action"),
        "symbol",
        "reason",
        "weight",
        F.col("live_score").alias("score"),
        F.when(sold, F.col("trigger_price")).otherwise(F.col("entry_price")).alias("price"),
    )
    resting = flat_now.select(
        F.col("strategy_id").alias("watch_id"), F.lit(anchor).alias("date"), F.lit("STAY_IN_BTC").alias("action"),
        F.lit("").alias("symbol"), F.col("in_btc").alias("reason"), flat_message().alias("message"),
    )
    both = rows.unionByName(resting, allowMissingColumns=True)
    return both.join(equity.select(F.col("strategy_id").alias("watch_id"), "equity"), "watch_id", "left")


def append_new(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (watch, date, action, symbol) is not stored yet."""
    return new.dropDuplicates(SIGNAL_KEYS).join(stored.select(*SIGNAL_KEYS).distinct(), SIGNAL_KEYS, "left_anti")


def _equity_at(rows: DataFrame, curve: DataFrame, when: str) -> DataFrame:
    """Add ``base``: the strategy's equity at the last curve point at or before a date.

    The asked dates of a strategy and its curve are one series, whose last equity is carried forward.
    """
    asked = rows.select("watch_id", F.col(when).alias("__day")).distinct().withColumns({"__e": F.lit(None).cast("double"), "__ask": F.lit(1)})
    points = curve.select(F.col("strategy_id").alias("watch_id"), F.col("anchor").alias("__day"), F.col("equity").alias("__e"), F.lit(0).alias("__ask"))
    order = Window.partitionBy("watch_id").orderBy("__day", "__ask")
    found = asked.unionByName(points).withColumn("base", F.last("__e", ignorenulls=True).over(order)).filter("__ask = 1")
    return rows.join(found.select("watch_id", F.col("__day").alias(when), "base"), ["watch_id", when], "left")


def return_since(signals: DataFrame, curve: DataFrame) -> DataFrame:
    """Paper move since each signal: equity now over equity at the signal date."""
    now = curve.groupBy(F.col("strategy_id").alias("watch_id")).agg(F.max_by("equity", "anchor").alias("now"))
    based = _equity_at(signals, curve, "date").join(now, "watch_id", "left")
    return based.withColumn("return_since", F.when(F.col("base") != 0, F.col("now") / F.col("base") - 1.0)).drop("now", "base")


def paper_return(watches: DataFrame, curve: DataFrame) -> DataFrame:
    """Return since the watch was created (its first curve point when created before it)."""
    ends = curve.groupBy(F.col("strategy_id").alias("watch_id")).agg(
        F.max_by("equity", "anchor").alias("last_equity"), F.min_by("equity", "anchor").alias("first_equity")
    )
    based = _equity_at(watches, curve, "created_at").join(ends, "watch_id")
    start = F.coalesce("base", "first_equity")
    return based.withColumn("start_equity", start).withColumn(
        "paper_return", F.when(start != 0, F.col("last_equity") / start - 1.0)
    ).drop("base", "first_equity")


def actionable(signals: DataFrame) -> DataFrame:
    """Signals worth a message, with its text."""
    words = F.create_map(*[F.lit(x) for pair in ACTION_WORDS.items() for x in pair])
    detail = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" ("), "reason", F.lit(")"))).otherwise("")
    symbol = F.when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit(" "), "symbol")).otherwise("")
    text = F.concat(
        F.lit("["), "watch_id", F.lit("] "), F.element_at(words, F.col("action")), symbol, detail, F.lit(" · anchor "),
        F.col("date").cast("string"),
    )
    return signals.filter(F.col("action").isin(ACTIONABLE)).withColumn("message", text)


def threshold_alerts(distances: DataFrame, watchlist: DataFrame, default: float = DEFAULT_THRESHOLD_PCT) -> DataFrame:
    """Crossings of the threshold: the first observation, or previous > threshold >= current.

    ``distances`` has symbol, ts and distance; the previous value is the symbol's own last one.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = distances.join(watchlist.select("symbol", "threshold_pct"), "symbol").withColumns(
        {"threshold": F.coalesce("threshold_pct", F.lit(default)), "previous": F.lag("distance").over(w)}
    )
    crossing = F.col("previous").isNull() | (F.col("previous") > F.col("threshold"))
    return rows.filter(crossing & (F.col("distance") <= F.col("threshold"))).select("symbol", "ts", "distance", "threshold")


#: Legal values of the parameters that are words.
WORDS = {
    "frequency": ["weekly", "monthly", "quarterly"], "weighting": ["equal", "score", "market_cap"], "rotation": ["rebalance", "hold"],
    "regime_filter": ["alt_trend", "breadth"],
}


def decode_strategies(saved: DataFrame, with_closes: bool = False) -> DataFrame:
    """Strategy rows of saved ones (strategy_id, params as JSON) with `error`, null where the strategy can run.

    A failure is a value here: JSON that is none, an unknown parameter, a value of the wrong type or outside its legal
    words, and rules the book does not apply each give the row its error, and the other rows go on.
    """
    given = saved.select("strategy_id", F.from_json("params", "map<string,string>").alias("given"))
    known = F.array(*[F.lit(n) for n in DEFAULTS])
    unknown = F.array_except(F.map_keys("given"), known)
    text = lambda n: F.try_element_at("given", F.lit(n))
    columns = {n: F.when(F.array_contains(F.map_keys("given"), n), text(n).try_cast(k)).otherwise(F.lit(d).cast(k)) for n, (k, d) in DEFAULTS.items()}
    wrong = [F.when(text(n).isNotNull() & text(n).try_cast(k).isNull(), F.lit(n)) for n, (k, _) in DEFAULTS.items()]
    parsed = given.select("strategy_id", "given", unknown.alias("unknown"), F.array_compact(F.array(*wrong)).alias("wrong"), *[c.alias(n) for n, c in columns.items()])
    named = lambda words, names: F.concat(F.lit(f"{words}: "), F.array_join(names, ", "))
    word = F.array_compact(F.array(*[F.when(F.col(n).isNotNull() & ~F.col(n).isin(w), F.lit(n)) for n, w in WORDS.items()]))
    refused = F.array_compact(F.array(*[F.when(v, F.lit(n)) for n, v in refused_rules(with_closes).items()]))
    slots = F.when(F.col("top_n") < 1, F.lit("top_n"))
    error = (
        F.when(F.col("given").isNull(), "not a JSON object")
        .when(F.size("unknown") > 0, named("unknown parameter", F.array_sort("unknown")))
        .when(F.size("wrong") > 0, named("wrong type", F.col("wrong")))
        .when(F.size(word) > 0, named("illegal value", word))
        .when(slots.isNotNull(), named("illegal value", F.array(slots)))
        .when(F.size(refused) > 0, named("rule the book does not apply", refused))
    )
    return parsed.select("strategy_id", *DEFAULTS, error.alias("error"))


def refresh_all(
    saved: DataFrame, panel: DataFrame, regime: DataFrame, candles: DataFrame, calendar: Calendar, stored: DataFrame, end: dt.date
) -> tuple[DataFrame, DataFrame]:
    """(rows new to the log, summary) of all saved strategies (strategy_id, params) in one run.

    The summary has one row per strategy: watch_id, signals (new ones) and error. A strategy that cannot run has its error
    and no signals; it neither ends the run nor touches the others.
    """
    decoded = materialize(decode_strategies(saved), "watches")
    valid = decoded.filter("error is null").drop("error")
    positions = materialize(book(panel, regime, valid, calendar), "watch-book")
    rows = materialize(periods(positions, panel, valid, calendar), "watch-periods")
    equity = equity_curve(rows).groupBy("strategy_id").agg(F.max_by("equity", "idx").alias("equity"))
    live = materialize(live_positions(positions, panel, candles, valid, calendar, end), "watch-live")
    anchors = calendar.frame(panel.sparkSession)
    last, anchor = anchors.agg(F.max("idx"), F.max("anchor")).first()
    flat = period_flags(positions, valid, regime, panel, calendar).filter(F.col("idx") == last - 1).select("strategy_id", "in_btc")
    inserted = materialize(append_new(signal_rows(live, flat, anchor, equity), stored), "watch-signals")
    counts = inserted.groupBy("watch_id").agg(F.count(F.lit(1)).alias("n"))
    summary = decoded.select(F.col("strategy_id").alias("watch_id"), "error").join(counts, "watch_id", "left")
    return inserted, summary.select("watch_id", F.coalesce("n", F.lit(0)).alias("signals"), "error")


def edit_watchlist(watchlist: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (symbol, threshold_pct, created_at, remove): add, change or remove rows."""
    kept = edits.filter(~F.col("remove")).select("symbol", "threshold_pct", "created_at")
    known = watchlist.select("symbol", F.col("created_at").alias("__created"))
    stamped = kept.join(known, "symbol", "left").select(
        "symbol", "threshold_pct", F.coalesce("__created", "created_at").alias("created_at")
    )
    return remove_keys(upsert(watchlist, stamped, ["symbol"]), edits.filter("remove"), ["symbol"])


def edit_strategies(
    strategies: DataFrame, signals: DataFrame, created: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Create and delete saved strategies; deleting one also deletes its signals.

    ``created`` carries strategy_id and any subset of the parameters; missing ones take defaults.
    """
    unknown = sorted(set(created.columns) - set(DEFAULTS) - {"strategy_id"})
    if unknown:
        raise ValueError(f"unknown strategy parameter: {', '.join(unknown)}")
    full = created.select(
        "strategy_id",
        *[
            F.coalesce(F.col(n), F.lit(d)).cast(k).alias(n) if n in created.columns else F.lit(d).cast(k).alias(n)
            for n, (k, d) in DEFAULTS.items()
        ],
    )
    kept = remove_keys(upsert(strategies, full, ["strategy_id"]), deleted, ["strategy_id"])
    gone = deleted.select(F.col("strategy_id").alias("watch_id"))
    return kept, remove_keys(signals, gone, ["watch_id"])


def _last_rows(panel: DataFrame, calendar: Calendar) -> DataFrame:
    last = calendar.frame(panel.sparkSession).agg(F.max("anchor")).select("max(anchor)").scalar()
    return panel.filter(F.col("anchor") == last).select("frequency", "symbol", "score")


def next_candidates(panel: DataFrame, held: DataFrame, strategies: DataFrame, calendar: Calendar) -> DataFrame:
    """Best rows of the last anchor that a strategy does not hold.

    A strategy needs no more of the ranked rows than it has slots and positions, so only the head of each of the two
    rankings (best and worst first) meets the strategies.
    """
    owned = held.select("strategy_id", "symbol").distinct()
    rules = strategies.select("strategy_id", "invert_score", F.greatest("top_n", F.lit(1)).alias("slots"))
    counts = owned.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("owned"))
    rules = rules.join(counts, "strategy_id", "left").withColumn("need", F.col("slots") + F.coalesce("owned", F.lit(0)))
    n, most = rules.agg(F.count(F.lit(1)), F.max("need")).first()
    pool = _last_rows(panel, calendar).select("symbol", "score")
    heads = [
        pool.orderBy(order, "symbol").limit(int(most or 0)).withColumn("invert_score", F.lit(turned))
        for turned, order in ((False, F.desc("score")), (True, F.asc("score")))
    ]
    head = heads[0].unionByName(heads[1])
    sign = F.when(F.col("invert_score"), -1.0).otherwise(1.0)
    best = (F.col("score") * sign).desc()
    head = head.withColumn("at", F.row_number().over(Window.partitionBy("invert_score").orderBy(best, "symbol")))
    rows = head.join(sent(rules, n), "invert_score").filter(F.col("at") <= F.col("need"))
    free = rows.join(owned, ["strategy_id", "symbol"], "left_anti")
    place = F.row_number().over(Window.partitionBy("strategy_id").orderBy("at"))
    return free.withColumn("place", place).filter(F.col("place") <= F.col("slots"))


def held_difference(panel: DataFrame, held: DataFrame, strategies: DataFrame, calendar: Calendar) -> DataFrame:
    """(strategy, symbol) of the last anchor's rows that a strategy does not hold: the whole set, as large as it is."""
    rules = strategies.select("strategy_id", "frequency")
    rows = _last_rows(panel, calendar).join(sent(rules, rules.count()), "frequency")
    return rows.join(held.select("strategy_id", "symbol"), ["strategy_id", "symbol"], "left_anti").select("strategy_id", "symbol")


def signal_history(signals: DataFrame, n: int) -> DataFrame:
    """Newest n signals of every watch."""
    place = F.row_number().over(Window.partitionBy("watch_id").orderBy(F.desc("date"), "action", "symbol"))
    return signals.withColumn("place", place).filter(F.col("place") <= n)


def tracked_symbols(state: DataFrame) -> DataFrame:
    """Distinct symbols of the long and the short book."""
    longs = state.filter("direction = 'long'").select("symbol")
    return longs.union(state.filter("direction = 'short'").select("symbol")).distinct().orderBy("symbol")
