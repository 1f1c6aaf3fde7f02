"""Set-wise strategy operators: every row of a strategies table is evaluated in the same job.

All tables are keyed by ``strategy_id``. The panel is cut once by the loosest floors of all strategies; a row then meets
the strategies whose score floor it reaches, by an equality join on the steps of the score (`reaching`), never all of
them. The strategies are the build side where their number is checked to be small. Everything after that is grouped by
(strategy, anchor) or (strategy, symbol).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.numeric import clamp, steady_avg, steady_sum
from tidemark.operators.asof import asof_rate
from tidemark.operators.calendar import Calendar
from tidemark.operators.research import rank_ic
from tidemark.plans.panel import forward_pairs, numbered
from tidemark.session import materialize


def _sa():
    return Window.partitionBy("strategy_id", "anchor")


def _zero() -> Column:
    return F.lit(0.0)


def _sign() -> Column:
    return F.when(F.col("invert_score"), -1.0).otherwise(1.0)


def liquid() -> Column:
    cap, volume = F.coalesce("cap", _zero()), F.coalesce("volume", _zero())
    return (
        (cap >= F.col("min_market_cap"))
        & (F.col("max_market_cap").isNull() | (cap <= F.col("max_market_cap")))
        & (volume >= F.col("min_volume"))
    )


#: Strategies up to this number are sent to all executors; a row of them is a few hundred bytes, its steps below 10 KB.
SENT = 10_000


def sent(strategies: DataFrame, count: int):
    """The build side of a join with the strategies: broadcast while they are few."""
    return F.broadcast(strategies) if count <= SENT else strategies


def limits(strategies: DataFrame) -> Row:
    """One row on the (small) strategies table: its size, its loosest floors and its most slots."""
    score = F.when(F.col("invert_score"), 0.0).otherwise(F.col("min_score"))
    top = F.when(F.col("invert_score"), 100.0 - F.col("min_score")).otherwise(None)
    cap = F.coalesce("max_market_cap", F.lit(float("inf")))
    return strategies.agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("score"), F.min("min_market_cap").alias("cap"), F.max(cap).alias("max_cap"),
        F.min("min_volume").alias("volume"), F.max("top_n").alias("top_n"), F.max("short_n").alias("short_n"),
        F.max("invert_score").alias("inverted"), F.max(top).alias("inverted_score"),
    ).first()


def within(rows: DataFrame, at: Row) -> DataFrame:
    """The panel rows that some strategy could trade by size and volume: literals, which reach the scan."""
    cap, volume = F.coalesce("cap", _zero()), F.coalesce("volume", _zero())
    kept = rows.filter((cap >= (at.cap or 0.0)) & (volume >= (at.volume or 0.0)))
    return kept if at.max_cap is None or at.max_cap == float("inf") else kept.filter(cap <= at.max_cap)


def _step(level: Column) -> Column:
    """Whole number of a score, 0 to 100; rows and floors beyond the ends count as the ends."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(level))).cast("int")


def reaching(rows: DataFrame, strategies: DataFrame, level: Column, floor: Column, count: int) -> DataFrame:
    """Rows of one frequency beside the strategies whose `floor` (of the strategy) is at or below `level` (of the row), to
    the whole number: those at the floor's own step are left to an exact filter of the caller.

    A dominance join as an equality join: a strategy stands at every whole step from its floor up, a row at one.
    """
    stands = strategies.withColumn("__step", F.explode(F.sequence(_step(F.coalesce(floor, F.lit(0.0))), F.lit(100))))
    return rows.withColumn("__step", _step(level)).join(sent(stands, count), ["frequency", "__step"]).drop("__step")


PANEL_ROW = ["frequency", "anchor", "symbol", "score", "distance", "price", "cap", "volume", "trend_30d"]


def _candidates(panel: DataFrame, strategies: DataFrame, at: Row) -> DataFrame:
    """(panel row, columns of the strategy) of all candidates, from the narrow `strategies`."""
    rows = within(panel.select(*PANEL_ROW), at)
    trend = F.col("min_trend_30d").isNull() | F.coalesce(F.col("trend_30d") >= F.col("min_trend_30d"), F.lit(False))
    plain, turned = strategies.filter("not invert_score"), strategies.filter("invert_score")
    found = reaching(rows.filter(F.col("score") >= (at.score or 0.0)), plain, F.col("score"), F.col("min_score"), at.n).filter(F.col("score") >= F.col("min_score"))
    if at.inverted:
        low = rows.filter(F.col("score") <= at.inverted_score)
        cheap = reaching(low, turned, 100.0 - F.col("score"), F.floor("min_score").cast("double"), at.n)
        found = found.unionByName(cheap.filter(F.col("score") <= 100.0 - F.col("min_score")))
    return found.filter(liquid() & trend)


RULE = ["strategy_id", "frequency", "invert_score", "min_score", "min_market_cap", "max_market_cap", "min_volume", "min_trend_30d"]


def with_rules(rows: DataFrame, strategies: DataFrame, count: int) -> DataFrame:
    """All columns of its strategy beside each row."""
    return rows.join(sent(strategies.drop("frequency"), count), "strategy_id")


def candidates(panel: DataFrame, strategies: DataFrame) -> DataFrame:
    """Panel rows each strategy may buy: score floor (mirrored when inverted), cap, volume, trend."""
    at = limits(strategies)
    return with_rules(_candidates(panel, strategies.select(*RULE), at).select(*PANEL_ROW, "strategy_id"), strategies, at.n)


def top_n_per_anchor(rows: DataFrame, slots: str, largest: int) -> DataFrame:
    """Best ``slots`` rows per strategy and anchor: score, then distance, then symbol. No strategy has more than
    ``largest`` slots, so the ranking is cut before its shuffle."""
    order = _sa().orderBy((F.col("score") * _sign()).desc(), F.col("distance").asc_nulls_last(), "symbol")
    placed = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= largest)
    return placed.filter(F.col("place") <= F.col(slots))


def picks_rebalance(panel: DataFrame, strategies: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Top-N candidates per anchor, without blocked (strategy, anchor, symbol) rows."""
    at = limits(strategies)
    rows = _candidates(panel, strategies.select(*RULE, "top_n"), at)
    if blocked is not None:
        rows = rows.join(blocked.select("strategy_id", "anchor", "symbol"), ["strategy_id", "anchor", "symbol"], "left_anti")
    chosen = top_n_per_anchor(rows, "top_n", int(at.top_n or 0))
    return with_rules(chosen.select(*PANEL_ROW, "strategy_id", "place"), strategies, at.n)


#: Exit rules of a position, and what else follows it from its entry on; rules that feed a strategy's own equity back.
EXIT_RULES = ["stop_loss_pct", "trailing_stop_pct", "take_profit_pct", "max_holding_periods", "profit_sweep_pct"]
EQUITY_RULES = ["equity_trend_exposure", "profit_lock_pct"]
DAILY_RULES = EXIT_RULES[:3]


def _has(column: str) -> Column:
    """A rule is set. No sweep is 0 per cent; an exposure of 0 is a rule."""
    return F.col(column).isNotNull() if column == "equity_trend_exposure" else F.coalesce(F.col(column) != 0, F.lit(False))


def refused_rules(with_closes: bool) -> dict[str, Column]:
    """Per rule whether a strategy sets it and the book does not apply it: rules on the equity (`equity_overlays` applies
    them to a book), exits of a strategy that rebalances, whose freed slots tie its symbols together, and exits on daily
    closes where the book is not given any."""
    turns = F.col("rotation") != "hold"
    refused = {c: _has(c) for c in EQUITY_RULES}
    return refused | {c: _has(c) if c in DAILY_RULES and not with_closes else _has(c) & turns for c in EXIT_RULES}


def refuse_path_rules(strategies: DataFrame, with_closes: bool) -> None:
    """Raise for strategies with a rule the book does not apply, rather than leave it out."""
    refused = refused_rules(with_closes)
    row = strategies.agg(*[F.max(v).alias(c) for c, v in refused.items()]).first()
    found = [c for c in refused if row[c]]
    if found:
        raise ValueError(f"the book does not apply {', '.join(found)}; apply these rules to its members")


def picks(panel: DataFrame, strategies: DataFrame, calendar: Calendar, candles: DataFrame | None = None) -> DataFrame:
    """Top-N candidates of the strategies that rebalance; every member of those that hold, with `keep`, the share of it
    that sweeps have left, and `exit_price` where a daily close ends it inside the period.

    A holding strategy keeps a symbol from its entry as a candidate until its score falls below the sell score or one of
    its exit rules ends the position, with no cap on its slots.
    """
    chosen = picks_rebalance(panel, strategies.filter("rotation != 'hold'"))
    chosen = chosen.withColumns({"keep": F.lit(1.0), "exit_price": F.lit(None).cast("double")})
    holding = strategies.filter("rotation = 'hold'")
    ruled = reduce(lambda a, b: a | b, [_has(c) for c in EXIT_RULES])
    free, bound = holding.filter(~ruled), holding.filter(ruled)
    keys = ["strategy_id", "symbol", "idx"]
    members = hysteresis_members(panel, free, calendar).select(*keys, F.lit(1.0).alias("keep"), F.lit(None).cast("double").alias("exit_price"))
    if not bound.isEmpty():
        paths = materialize(position_paths(panel, bound, candles, calendar), "paths")
        exits = paths.filter("kind = 'exit'").select(*keys, F.col("price").alias("exit_price"))
        members = members.unionByName(paths.filter("kind = 'member'").select(*keys, "keep").join(exits, keys, "left"))
    rows = numbered(panel.select(*PANEL_ROW), calendar).join(members, ["symbol", "idx"])
    held = with_rules(rows.select(*PANEL_ROW, "strategy_id", "keep", "exit_price"), holding, limits(holding).n)
    return chosen.unionByName(held.withColumn("place", F.lit(None).cast("int")).select(*chosen.columns))


def weights(picks: DataFrame) -> DataFrame:
    """Equal, score-proportional or cap-proportional weights that sum to one per anchor."""
    n = F.count(F.lit(1)).over(_sa())
    whole = _sa().orderBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    score_sum, cap_sum = F.sum("score").over(whole), F.sum(F.coalesce("cap", _zero())).over(whole)
    by_score = F.col("score") / F.when(score_sum == 0, 1.0).otherwise(score_sum)
    by_cap = F.when(cap_sum <= 0, 1.0 / n).otherwise(F.coalesce("cap", _zero()) / cap_sum)
    mode = F.col("weighting")
    return picks.withColumn(
        "weight", F.when(mode == "score", by_score).when(mode == "market_cap", by_cap).otherwise(1.0 / n)
    )


def fill_with_numeraire(weighted: DataFrame) -> DataFrame:
    """Leave empty slots in the numeraire: scale by filled slots over all slots."""
    share = F.least(F.count(F.lit(1)).over(_sa()) / F.col("top_n"), F.lit(1.0))
    return weighted.withColumn("weight", F.when(F.col("fill_with_btc"), F.col("weight") * share).otherwise(F.col("weight")))


def risk_flags(strategies: DataFrame, regime: DataFrame) -> DataFrame:
    """(strategy, anchor, risk_on): one row per strategy and anchor of its frequency."""
    rules = strategies.select("strategy_id", "frequency", "regime_filter", "regime_min_breadth")
    rows = rules.join(F.broadcast(regime.select("frequency", "anchor", "alt_above_sma", "breadth")), "frequency")
    by_trend = F.coalesce("alt_above_sma", F.lit(True))
    by_breadth = F.col("breadth").isNull() | (F.col("breadth") >= F.col("regime_min_breadth"))
    mode = F.col("regime_filter")
    risk_on = F.when(mode == "alt_trend", by_trend).when(mode == "breadth", by_breadth).otherwise(True)
    return rows.select("strategy_id", "anchor", risk_on.alias("risk_on"))


def regime_gate(weighted: DataFrame, flags: DataFrame) -> DataFrame:
    """Risk-off anchors: drop the picks (no exposure) or scale them."""
    rows = weighted.join(flags, ["strategy_id", "anchor"], "left").withColumn("risk_on", F.coalesce("risk_on", F.lit(True)))
    kept = rows.filter(F.col("risk_on") | (F.col("regime_exposure") > 0))
    scale = clamp(F.col("regime_exposure"), 0.0, 1.0)
    return kept.withColumn("weight", F.when(F.col("risk_on"), F.col("weight")).otherwise(F.col("weight") * scale))


def short_sleeve(panel: DataFrame, strategies: DataFrame, longs: DataFrame) -> DataFrame:
    """The N lowest scores (highest when inverted) outside the long book, equal negative weights."""
    shorting = strategies.filter("short_n > 0")
    at = limits(shorting)
    rules = shorting.select("strategy_id", "frequency", "invert_score", "min_market_cap", "max_market_cap", "min_volume", "short_n", "short_max_score")
    # A ceiling on the score is a floor on what is missing to 100, at the whole number below.
    rows = reaching(within(panel.select(*PANEL_ROW), at), rules, 100.0 - F.col("score"), F.floor(100.0 - F.col("short_max_score")).cast("double"), at.n)
    allowed = F.col("short_max_score").isNull() | (F.col("score") <= F.col("short_max_score"))
    keys = ["strategy_id", "anchor", "symbol"]
    free = rows.filter(liquid() & allowed).join(longs.select(*keys), keys, "left_anti")
    order = _sa().orderBy((F.col("score") * _sign()).asc(), "symbol")
    placed = free.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= int(at.short_n or 0))
    taken = with_rules(placed.filter(F.col("place") <= F.col("short_n")).select(*PANEL_ROW, "strategy_id", "place"), shorting, at.n)
    return taken.withColumn("weight", -clamp(F.col("short_exposure"), 0.0, 1.0) / F.col("short_n"))


def anchor_ic(panel: DataFrame, calendar: Calendar, min_pairs: int = 8) -> DataFrame:
    """Per anchor the rank correlation of the previous anchor's score with the return realised since."""
    pairs = forward_pairs(panel, calendar, 1, ("score",), both=False)
    wide = pairs.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pairs)
    rows = pairs.join(wide.select("idx"), "idx", "left_semi").select("idx", "symbol", F.col("score").alias("value"), "ret")
    return rank_ic(rows, ["idx"]).select((F.col("idx") + 1).alias("idx"), "ic")


def rolling_ic(ic: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Mean of the last ``max(2, window)`` measured values at every anchor, null before three."""
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    known = ic.filter(F.col("ic").isNotNull())
    count = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    mean = F.avg("ic").over(w.rowsBetween(-(max(2, window) - 1), 0))
    rolled = known.select("idx", "ic", F.when(count >= 3, mean).alias("m"), count.alias("c"))
    carried = F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return anchors.join(rolled, "idx", "left").select("idx", "anchor", "ic", carried.alias("rolling_ic"))


def ic_flags(panel: DataFrame, calendar: Calendar, strategies: DataFrame) -> DataFrame:
    """(strategy, anchor, rolling_ic, ic_risk_on) of the strategies with factor timing.

    One calendar-sized series holds all window lengths: a mean is the difference of two running sums.
    """
    timed = strategies.filter("ic_filter").select("strategy_id", "ic_window", "ic_threshold")
    windows = timed.select(F.collect_set("ic_window")).scalar()
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    known = anchor_ic(panel, calendar).filter(F.col("ic").isNotNull())
    known = known.select("idx", "ic", F.row_number().over(w).alias("c"), F.sum("ic").over(w).alias("s"))
    length = F.greatest(F.lit(2), F.col("ic_window"))
    rolled = known.withColumn("w", windows).select("idx", "ic", "c", "s", F.explode("w").alias("ic_window")).withColumn("c0", F.col("c") - length)
    rolled = rolled.join(known.select(F.col("c").alias("c0"), F.col("s").alias("s0")), "c0", "left")
    mean = (F.col("s") - F.coalesce("s0", _zero())) / F.least(F.col("c"), length)
    rolled = rolled.select("idx", "ic_window", "ic", F.when(F.col("c") >= 3, mean).alias("m"))
    anchors = calendar.frame(panel.sparkSession).select("idx", "anchor").withColumn("w", windows)
    carried = F.last("m", ignorenulls=True).over(Window.partitionBy("ic_window").orderBy("idx"))
    series = anchors.select("idx", "anchor", F.explode("w").alias("ic_window")).join(rolled, ["idx", "ic_window"], "left").withColumn("rolling_ic", carried)
    on = F.col("rolling_ic").isNull() | (F.col("rolling_ic") > F.col("ic_threshold"))
    return timed.join(series, "ic_window").select("strategy_id", "anchor", "ic", "rolling_ic", on.alias("ic_risk_on"))


def ic_timing(weighted: DataFrame, flags: DataFrame) -> DataFrame:
    """Scale all weights of an anchor while the factor's own rolling correlation is too low."""
    rows = weighted.join(flags.select("strategy_id", "anchor", "ic_risk_on"), ["strategy_id", "anchor"], "left")
    scale = F.when(F.coalesce("ic_risk_on", F.lit(True)), 1.0).otherwise(clamp(F.col("ic_exposure"), 0.0, 1.0))
    return rows.withColumn("weight", F.col("weight") * scale)


BOOK = ["strategy_id", "frequency", "anchor", "symbol", "direction", "score", "price", "weight", "keep", "exit_price"]


def book(panel: DataFrame, regime: DataFrame, strategies: DataFrame, calendar: Calendar, candles: DataFrame | None = None) -> DataFrame:
    """Target weights of every strategy at every anchor, longs and shorts; raises for rules it does not apply.

    With daily closes (`candles`) strategies that hold may have stops, trailing stops and targets; a row whose position ends
    inside its period carries the `exit_price`. `keep` is what profit sweeps have left of the position.
    """
    refuse_path_rules(strategies, candles is not None)
    chosen = picks(panel, strategies, calendar, candles)
    sized = fill_with_numeraire(weights(chosen)).withColumn("weight", F.col("weight") * F.col("keep"))
    longs = regime_gate(sized, risk_flags(strategies, regime))
    shorts = short_sleeve(panel, strategies, longs).withColumns({"keep": F.lit(1.0), "exit_price": F.lit(None).cast("double")})
    cols = [*[c for c in BOOK if c != "direction"], "ic_exposure"]
    both = longs.select(*cols, F.lit("long").alias("direction")).unionByName(
        shorts.select(*cols, F.lit("short").alias("direction"))
    )
    return numbered(ic_timing(both, ic_flags(panel, calendar, strategies)).select(*BOOK), calendar)


def position_returns(positions: DataFrame, panel: DataFrame, calendar: Calendar) -> DataFrame:
    """Return of every position to the next anchor, or to the close that ends it before.

    A long without a next row earns nothing; a short without one leaves the period. The last
    anchor has no period. ``pick_return`` shows a short's gain with its sign turned.
    """
    later = numbered(panel, calendar).select((F.col("idx") - 1).alias("idx"), "symbol", F.col("price").alias("next_price"))
    last = calendar.frame(panel.sparkSession).agg(F.max("idx")).select("max(idx)").scalar()
    rows = positions.filter(F.col("idx") < last).join(later, ["idx", "symbol"], "left")
    kept = rows.filter((F.col("direction") == "long") | F.col("next_price").isNotNull())
    end = F.coalesce(*([F.col("exit_price")] if "exit_price" in positions.columns else []), "next_price", "price")
    ret = F.when(F.col("price") != 0, end / F.col("price") - 1.0).otherwise(0.0)
    return kept.withColumn("ret", ret).withColumn(
        "pick_return", F.when(F.col("direction") == "short", -F.col("ret")).otherwise(F.col("ret"))
    )


def turnover(positions: DataFrame) -> DataFrame:
    """Traded notional per strategy and anchor: sum of absolute weight changes.

    Each weight counts at its own anchor and, negated, at the next one; adding both per symbol is
    the difference, without a self-join.
    """
    w = positions.select("strategy_id", "idx", "symbol", "weight")
    shifted = w.select("strategy_id", (F.col("idx") + 1).alias("idx"), "symbol", (-F.col("weight")).alias("weight"))
    change = w.unionByName(shifted).groupBy("strategy_id", "idx", "symbol").agg(F.sum("weight").alias("d"))
    return change.groupBy("strategy_id", "idx").agg(steady_sum(F.abs("d")).alias("traded"))


def periods(positions: DataFrame, panel: DataFrame, strategies: DataFrame, calendar: Calendar) -> DataFrame:
    """One row per strategy and period: gross return, fee, funding and net return.

    The sums do not depend on the order of the rows, so strategies with equal positions have equal figures to the last bit.
    """
    earned = position_returns(positions, panel, calendar).groupBy("strategy_id", "idx").agg(
        steady_sum(F.col("weight") * F.col("ret")).alias("gross"), F.count(F.lit(1)).alias("holdings")
    )
    sides = positions.groupBy("strategy_id", "idx").agg(
        steady_sum(F.when(F.col("direction") == "short", F.abs("weight")).otherwise(0.0)).alias("short_notional"),
        steady_sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("long_notional"),
    )
    frame = calendar.frame(panel.sparkSession).filter("next_anchor is not null")
    config = strategies.select("strategy_id", "frequency", "fee_pct", "short_funding_apr")
    rows = (
        config.join(F.broadcast(frame), "frequency")
        .join(earned, ["strategy_id", "idx"], "left")
        .join(sides, ["strategy_id", "idx"], "left")
        .join(turnover(positions), ["strategy_id", "idx"], "left")
        .fillna(0.0, ["gross", "short_notional", "long_notional", "traded"])
        .fillna(0, ["holdings"])
    )
    days = F.greatest(F.datediff("next_anchor", "anchor"), F.lit(1))
    return rows.withColumns(
        {
            "turnover": F.col("traded") / 2,
            "fee": F.col("traded") * F.col("fee_pct") / 100.0,
            "funding": F.col("short_notional") * (F.col("short_funding_apr") / 100.0) * days / 365.0,
        }
    ).withColumn("period_return", F.col("gross") - (F.col("fee") + F.col("funding")))


def equity_curve(period_rows: DataFrame) -> DataFrame:
    """Compounded equity from 1.0: the first anchor, then one point per period end.

    Ordered inside one strategy, so the series is as long as the calendar.
    """
    w = Window.partitionBy("strategy_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    later = period_rows.select(
        "strategy_id",
        (F.col("idx") + 1).alias("idx"),
        F.col("next_anchor").alias("anchor"),
        "period_return",
        F.product(1.0 + F.col("period_return")).over(w).alias("equity"),
    )
    start = period_rows.filter("idx = 0").select(
        "strategy_id", "idx", "anchor", _zero().alias("period_return"), F.lit(1.0).alias("equity")
    )
    return start.unionByName(later)


def drawdowns(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("strategy_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)


def equity_in_quote(curve: DataFrame, rates: DataFrame, calendar: Calendar) -> DataFrame:
    """Equity and buy-and-hold of the numeraire in the quote currency (first rate before the series)."""
    priced = asof_rate(curve, rates, "anchor", "clamp")
    w = Window.partitionBy("strategy_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    base = F.first("rate").over(w)
    usable = base.isNotNull() & (base != 0)
    return priced.withColumns(
        {
            "equity_usd": F.when(usable, F.col("equity") * F.col("rate") / base),
            "benchmark_usd": F.when(usable, F.col("rate") / base),
        }
    )


def performance_metrics(curve: DataFrame, period_rows: DataFrame, frequency: str) -> DataFrame:
    """One row per strategy. ``curve`` carries the quote-currency columns."""
    per_year = 365.0 / P.FREQUENCY_DAYS[frequency]
    ends = drawdowns(curve).groupBy("strategy_id").agg(
        F.max_by("equity", "idx").alias("final"),
        F.max_by("equity_usd", "idx").alias("usd"),
        F.max_by("benchmark_usd", "idx").alias("bench"),
        F.least(_zero(), F.min("drawdown")).alias("max_drawdown"),
        F.datediff(F.max("anchor"), F.min("anchor")).alias("days"),
    )
    r = F.col("period_return")
    body = period_rows.groupBy("strategy_id").agg(
        F.avg(r).alias("m"),
        F.coalesce(F.stddev_samp(r), _zero()).alias("s"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg("holdings").alias("avg_holdings"),
        steady_avg(F.col("turnover")).alias("avg_turnover"),
        steady_avg(F.col("short_notional")).alias("avg_short_notional"),
        steady_avg(F.col("long_notional")).alias("avg_long_notional"),
        steady_sum(F.col("funding")).alias("funding_cost"),
        F.count(F.lit(1)).alias("periods"),
    )
    years = F.greatest(F.col("days") / 365.0, F.lit(1 / 365.0))
    cagr = F.when(F.col("final") > 0, F.pow(F.col("final"), 1.0 / years) - 1.0).otherwise(-1.0)
    rows = body.join(ends, "strategy_id").withColumn("cagr", cagr)
    return rows.select(
        "strategy_id",
        (F.col("final") - 1.0).alias("total_return"),
        (F.col("usd") - 1.0).alias("total_return_usd"),
        (F.col("bench") - 1.0).alias("benchmark_return"),
        "cagr",
        (F.col("s") * per_year**0.5).alias("volatility"),
        F.when(F.col("s") > 0, F.col("m") / F.col("s") * per_year**0.5).otherwise(0.0).alias("sharpe"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "win_rate", "avg_holdings", "avg_turnover", "avg_short_notional", "avg_long_notional", "funding_cost", "periods",
    )


def _half_even(x: float) -> int:
    return int(round(x))


def consistency_metrics(curve: DataFrame, keys: list[str], frequency: str, start_equity: str | None = None, sliced: bool = False) -> DataFrame:
    """Positive years, positive rolling one-year windows, time in drawdown, share of the best periods.

    ``curve`` has keys, idx, anchor, equity, period_return; its first point per key is the start
    (no return). With ``sliced`` the rolling window is scaled to the slice.
    """
    per_year = 365.0 / P.FREQUENCY_DAYS[frequency]
    year_window = _half_even(per_year)
    w = Window.partitionBy(*keys).orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumns(
        {
            "k": F.row_number().over(w) - 1,
            "peak": F.max("equity").over(whole),
            "n": F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1,
        }
    )
    if sliced:
        length = F.least(F.lit(year_window), F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    else:
        length = F.lit(max(4, year_window))
    rows = rows.withColumn("length", length.cast("int"))
    # Growth over a window is the ratio of the equity at its end and its start; a history shorter
    # than the window forms one partial window.
    ends = rows.select(*keys, F.col("k").alias("k1"), F.col("equity").alias("e1"), "n", "length")
    starts = rows.select(*keys, (F.col("k") + F.least("length", "n")).alias("k1"), F.col("equity").alias("e0"))
    rolling = ends.join(starts, [*keys, "k1"]).groupBy(*keys).agg(
        F.avg((F.col("e1") / F.col("e0") > 1.0).cast("double")).alias("positive_rolling_share")
    )
    years = rows.groupBy(*keys, F.year("anchor").alias("year")).agg(F.max_by("equity", "idx").alias("e"))
    first = rows.filter("k = 0").select(*keys, F.col("equity").alias("e_first"))
    before = F.lag("e").over(Window.partitionBy(*keys).orderBy("year"))
    yearly = years.join(first, keys).withColumn("ret", F.col("e") / F.coalesce(before, "e_first") - 1.0)
    positive = yearly.groupBy(*keys).agg(F.avg((F.col("ret") > 0).cast("double")).alias("positive_years"))
    gains = rows.filter((F.col("k") > 0) & (F.col("period_return") > 0))
    best = F.greatest(F.lit(1), F.rint(F.col("n") * 0.05).cast("int"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("period_return"), "idx"))
    shares = gains.withColumn("place", place).groupBy(*keys).agg(
        (F.sum(F.when(F.col("place") <= best, F.col("period_return"))) / F.sum("period_return")).alias("best_period_share")
    )
    below = rows.groupBy(*keys).agg(F.avg((F.col("equity") < F.col("peak") - 1e-12).cast("double")).alias("time_in_drawdown"))
    return (
        below.join(positive, keys)
        .join(rolling, keys, "left")
        .join(shares, keys, "left")
        .withColumns(
            {
                "positive_rolling_share": F.coalesce("positive_rolling_share", _zero()),
                "best_period_share": F.coalesce("best_period_share", F.lit(1.0)),
            }
        )
    )


# --- positions over time ------------------------------------------------------------------------
def spells(members: DataFrame, keys: tuple[str, ...] = ("strategy_id", "symbol")) -> DataFrame:
    """Number the runs of consecutive anchors per key: ``spell`` and the 0-based ``held`` inside it."""
    w = Window.partitionBy(*keys).orderBy("idx")
    run = F.col("idx") - F.row_number().over(w)
    rows = members.withColumn("spell", run)
    inside = Window.partitionBy(*keys, "spell").orderBy("idx")
    return rows.withColumns(
        {
            "held": F.row_number().over(inside) - 1,
            "entry_price": F.first("price").over(inside),
            "entry_anchor": F.first("anchor").over(inside),
        }
    )


def exit_reason(time_exit: Column, risk_on: Column, rotation: Column, missing: Column) -> Column:
    """Precedence: time, regime, rebalance, missing, score."""
    return (
        F.when(time_exit, "time")
        .when(~risk_on, "regime")
        .when(rotation == "rebalance", "rebalance")
        .when(missing, "missing")
        .otherwise("score")
    )


def trade_log(positions: DataFrame, panel: DataFrame, flags: DataFrame, strategies: DataFrame, calendar: Calendar) -> DataFrame:
    """Entries and exits of the long book: one row per unbroken membership.

    A position leaves at the first anchor that no longer holds it, at that anchor's price or its
    last seen price; what is held in the final period stays open at the last anchor.
    """
    anchors = calendar.frame(panel.sparkSession).select("idx", F.col("anchor").alias("exit_anchor"))
    last = calendar.frame(panel.sparkSession).agg(F.max("idx")).select("max(idx)").scalar()
    members = spells(positions.filter((F.col("direction") == "long") & (F.col("idx") < last)))
    runs = members.groupBy("strategy_id", "symbol", "spell").agg(
        F.min("anchor").alias("entry_anchor"),
        F.min_by("price", "idx").alias("entry_price"),
        F.min_by("score", "idx").alias("entry_score"),
        F.max_by("price", "idx").alias("last_price"),
        (F.max("idx") + 1).alias("idx"),
    )
    quotes = numbered(panel, calendar).select("idx", "symbol", F.col("price").alias("quote"))
    rows = (
        runs.join(anchors, "idx")
        .join(quotes, ["idx", "symbol"], "left")
        .join(flags.withColumnRenamed("anchor", "exit_anchor"), ["strategy_id", "exit_anchor"], "left")
        .join(strategies.select("strategy_id", "rotation"), "strategy_id")
    )
    reason = exit_reason(F.lit(False), F.coalesce("risk_on", F.lit(True)), F.col("rotation"), F.col("quote").isNull())
    price = F.coalesce("quote", "last_price")
    return rows.select(
        "strategy_id",
        "symbol",
        "entry_anchor",
        "entry_price",
        "entry_score",
        "exit_anchor",
        price.alias("exit_price"),
        F.when(F.col("idx") == last, "open").otherwise(reason).alias("reason"),
        F.when(F.col("entry_price") != 0, price / F.col("entry_price") - 1.0).otherwise(0.0).alias("ret"),
        F.datediff("exit_anchor", "entry_anchor").alias("days"),
    )


def trade_stats(trades: DataFrame) -> DataFrame:
    """Totals, open positions, win rate and returns of the closed trades per strategy."""
    closed = F.col("reason") != "open"
    ret = F.when(closed, F.col("ret"))
    return trades.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~closed).alias("open"),
        F.coalesce(F.avg(F.when(closed, (F.col("ret") > 0).cast("double"))), _zero()).alias("win_rate"),
        F.coalesce(F.avg(ret), _zero()).alias("mean"),
        F.coalesce(F.max(ret), _zero()).alias("best"),
        F.coalesce(F.min(ret), _zero()).alias("worst"),
    )


def short_spells(positions: DataFrame) -> DataFrame:
    """Entry, last price and periods held of every unbroken short membership."""
    runs = spells(positions.filter(F.col("direction") == "short"))
    return runs.groupBy("strategy_id", "symbol", "spell").agg(
        F.min("anchor").alias("entry_anchor"),
        F.min_by("price", "idx").alias("entry_price"),
        F.max_by("price", "idx").alias("last_price"),
        F.max("held").alias("periods_held"),
        F.max("idx").alias("last_idx"),
    )


def hysteresis_members(panel: DataFrame, strategies: DataFrame, calendar: Calendar) -> DataFrame:
    """Membership with an entry and an exit threshold (no slot cap).

    A symbol enters as a candidate, stays while its score is at least the sell score (default: the
    buy floor), and leaves below it or when its panel row is missing.

    A row that neither enters nor stays ends a membership just as a missing one does, so only rows that reach the sell score
    and candidates are ever joined with a strategy.
    """
    at = limits(strategies)
    rules = strategies.select(*RULE, F.coalesce("sell_score", "min_score").alias("sell"))
    row = ["strategy_id", "frequency", "anchor", "symbol", "score", "price"]
    staying = reaching(panel.select(*PANEL_ROW), rules, F.col("score"), F.col("sell"), at.n).filter(F.col("score") >= F.col("sell"))
    entering = _candidates(panel, rules.drop("sell"), at)
    marked = staying.select(*row, F.lit(0).alias("enter")).unionByName(entering.select(*row, F.lit(1).alias("enter")))
    rows = numbered(marked.groupBy(*row).agg(F.max("enter").alias("enter")), calendar)
    keys = ["strategy_id", "symbol"]
    segmented = rows.withColumn("segment", F.col("idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("idx")))
    inside = Window.partitionBy(*keys, "segment").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return segmented.withColumn("entered", F.max("enter").over(inside)).filter("entered = 1").select(
        "strategy_id", "symbol", "idx", "anchor", "score", "price"
    )


def first_exit(positions: DataFrame, candles: DataFrame, calendar: Calendar) -> DataFrame:
    """First daily close in (anchor, next anchor] that triggers a stop, trailing stop or target.

    ``positions`` has strategy_id, symbol, idx, entry_price, peak and the three percentages. Every
    candle belongs to exactly one period, so the range condition is an equality join on
    (symbol, period).
    """
    daily = candles.select("symbol", "ts", "close", period_index(calendar, F.col("ts")).alias("idx"))
    rows = positions.join(daily, ["symbol", "idx"])
    w = Window.partitionBy("strategy_id", "symbol", "idx").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run_peak", F.greatest("peak", F.max("close").over(w)))
    e, c = F.col("entry_price"), F.col("close")
    hit = (
        F.when(c <= e * (1.0 - F.col("stop_loss_pct") / 100.0), "stop_loss")
        .when(c <= F.col("run_peak") * (1.0 - F.col("trailing_stop_pct") / 100.0), "trailing_stop")
        .when(c >= e * (1.0 + F.col("take_profit_pct") / 100.0), "take_profit")
    )
    return (
        rows.withColumn("reason", hit)
        .filter(F.col("reason").isNotNull())
        .groupBy("strategy_id", "symbol", "idx")
        .agg(F.min_by(F.struct("ts", "close", "reason", "run_peak"), "ts").alias("r"))
        .select("strategy_id", "symbol", "idx", F.col("r.ts").alias("ts"), F.col("r.close").alias("price"), "r.reason", "r.run_peak")
    )


def period_index(calendar: Calendar, ts: Column) -> Column:
    """Index i of the period (anchor i, anchor i+1] that holds a day; negative before the first."""
    first = F.lit(calendar.first)
    if calendar.frequency == "weekly":
        return F.ceil(F.datediff(ts, first) / 7).cast("int") - 1
    step = {"monthly": 1, "quarterly": 3}[calendar.frequency]
    months = (F.year(ts) - calendar.first.year) * 12 + F.month(ts) - calendar.first.month
    months = months + F.when(F.dayofmonth(ts) > 1, 1).otherwise(0)
    return F.ceil(months / step).cast("int") - 1


def exit_levels(positions: DataFrame) -> DataFrame:
    """Trigger prices and profit in percent terms (short: entry over price)."""
    e, now = F.col("entry_price"), F.col("price_now")
    pnl = F.when(F.col("direction") == "short", e / now - 1.0).otherwise(now / e - 1.0)
    set_ = lambda p: F.col(p).isNotNull() & (F.col(p) != 0) & (F.col("direction") == "long")
    return positions.withColumns(
        {
            "pnl": F.when((e != 0) & (now != 0), F.round(pnl, 4)),
            "stop_price": F.when(set_("stop_loss_pct"), F.round(e * (1.0 - F.col("stop_loss_pct") / 100.0), 8)),
            "trailing_stop_price": F.when(
                set_("trailing_stop_pct"), F.round(F.col("peak") * (1.0 - F.col("trailing_stop_pct") / 100.0), 8)
            ),
            "take_profit_price": F.when(set_("take_profit_pct"), F.round(e * (1.0 + F.col("take_profit_pct") / 100.0), 8)),
        }
    )


def time_stop(members: DataFrame, limit: str = "max_holding_periods") -> DataFrame:
    """Cut positions held for the maximum number of anchors, and let them in again.

    A run that is a candidate throughout is held for the limit, sold at the next anchor, blocked at the one after, and held
    again: the place in the run modulo limit + 2 tells which. `held` counts the anchors since the last entry.
    """
    runs = spells(members)
    place = F.pmod(F.col("held"), F.col(limit) + 2)
    free = F.col(limit).isNull()
    return runs.withColumn("held", F.when(free, F.col("held")).otherwise(place)).filter(free | (F.col("held") < F.col(limit)))


_EVENT = "struct<kind:string,idx:int,price:double,score:double,held:int,entry_price:double,peak:double,keep:double,ts:date,reason:string>"


def position_paths(panel: DataFrame, strategies: DataFrame, candles: DataFrame | None, calendar: Calendar) -> DataFrame:
    """Positions of holding strategies with stop, trailing stop, target, time limit, profit sweep and re-entry.

    (strategy_id, symbol, kind, idx, price, score, held, entry_price, peak, keep, ts, reason): `kind` is member for each
    anchor a symbol is held at, exit for the first daily close that ends a position inside a period, time for an anchor a
    position is sold at because of its age. After an exit or a time sale the symbol is blocked for one anchor.

    Symbols do not depend on one another, as slots are not capped: the path of one symbol is a fold over its own anchors
    and closes in the order of time, one row of calendar size, after one shuffle by (strategy, symbol).
    """
    at = limits(strategies)
    rules = strategies.select(*RULE, F.coalesce("sell_score", "min_score").alias("sell"))
    row = ["strategy_id", "frequency", "anchor", "symbol", "score", "price"]
    staying = reaching(panel.select(*PANEL_ROW), rules, F.col("score"), F.col("sell"), at.n).filter(F.col("score") >= F.col("sell"))
    entering = _candidates(panel, rules.drop("sell"), at)
    marked = staying.select(*row, F.lit(0).alias("enter")).unionByName(entering.select(*row, F.lit(1).alias("enter")))
    anchors = numbered(marked.groupBy(*row).agg(F.max("enter").alias("enter")), calendar)
    keys = ["strategy_id", "symbol"]
    none = F.lit(None)
    decided = anchors.select(*keys, F.col("idx").cast("int").alias("idx"), F.lit(0).alias("day"), F.col("anchor").alias("ts"), "price", "score", (F.col("enter") == 1).alias("enter"))
    events = decided
    if candles is not None:
        daily = candles.select("symbol", "ts", F.col("close").alias("price"), period_index(calendar, F.col("ts")).cast("int").alias("idx"))
        watched = strategies.filter(" or ".join(f"{c} is not null" for c in DAILY_RULES)).select("strategy_id")
        open_ = decided.join(sent(watched, at.n), "strategy_id", "left_semi").select(*keys, "idx")
        closes = open_.join(daily, ["symbol", "idx"]).select(*keys, "idx", F.lit(1).alias("day"), "ts", "price", none.cast("double").alias("score"), none.cast("boolean").alias("enter"))
        events = decided.unionByName(closes)
    series = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "day", "ts", "price", "score", "enter"))).alias("series"))
    ruled = series.join(sent(strategies.select("strategy_id", *EXIT_RULES), at.n), "strategy_id")

    def event(kind: str, e: Column, state: dict[str, Column], reason: Column) -> Column:
        parts = [F.lit(kind), e["idx"], e["price"], e["score"], state["held"], state["entry"], state["peak"], state["keep"], e["ts"], reason]
        names = ["kind", "idx", "price", "score", "held", "entry_price", "peak", "keep", "ts", "reason"]
        return F.struct(*[p.alias(n) for p, n in zip(parts, names)])

    def state(acc: Column, **new: Column) -> Column:
        names = ["entry", "peak", "keep", "held", "at", "blocked", "out"]
        return F.struct(*[new.get(n, acc[n]).alias(n) for n in names])

    def anchor_step(acc: Column, e: Column) -> Column:
        """At an anchor: stay, be sold for its age, enter, or stand aside. `at` is the last anchor held, -9 outside."""
        holds = acc["at"] == e["idx"] - 1
        old = holds & (F.col("max_holding_periods").isNotNull() & (acc["held"] + 1 >= F.col("max_holding_periods")))
        gain = e["price"] / acc["entry"] - 1.0
        swept = F.coalesce(F.col("profit_sweep_pct"), _zero()) / 100.0 * gain / (1.0 + gain)
        gained = (acc["entry"] != 0) & (e["price"] > acc["entry"])
        keep = F.when(gained, acc["keep"] * (1.0 - F.least(F.lit(0.9), swept))).otherwise(acc["keep"])
        stays = {"held": acc["held"] + 1, "entry": acc["entry"], "peak": F.greatest(acc["peak"], e["price"]), "keep": keep}
        begins = {"held": F.lit(0), "entry": e["price"], "peak": e["price"], "keep": F.lit(1.0)}
        no = F.lit(None).cast("string")
        sold = state(acc, at=F.lit(-9), blocked=e["idx"] + 1, out=F.array_append(acc["out"], event("time", e, stays, F.lit("time"))))
        kept = state(acc, **stays, at=e["idx"], out=F.array_append(acc["out"], event("member", e, stays, no)))
        entered = state(acc, **begins, at=e["idx"], out=F.array_append(acc["out"], event("member", e, begins, no)))
        may = e["enter"] & (acc["blocked"] != e["idx"])
        return F.when(old, sold).when(holds, kept).when(may, entered).otherwise(state(acc, at=F.lit(-9)))

    def close_step(acc: Column, e: Column) -> Column:
        """At a daily close of a period that began with the position."""
        peak = F.greatest(acc["peak"], e["price"])
        reason = (
            F.when(e["price"] <= acc["entry"] * (1.0 - F.col("stop_loss_pct") / 100.0), "stop_loss")
            .when(e["price"] <= peak * (1.0 - F.col("trailing_stop_pct") / 100.0), "trailing_stop")
            .when(e["price"] >= acc["entry"] * (1.0 + F.col("take_profit_pct") / 100.0), "take_profit")
        )
        now = {"held": acc["held"], "entry": acc["entry"], "peak": peak, "keep": acc["keep"]}
        out = state(acc, at=F.lit(-9), blocked=e["idx"] + 1, out=F.array_append(acc["out"], event("exit", e, now, reason)))
        return F.when(acc["at"] != e["idx"], acc).when(reason.isNotNull(), out).otherwise(state(acc, peak=peak))

    start = F.struct(
        _zero().alias("entry"), _zero().alias("peak"), F.lit(1.0).alias("keep"), F.lit(0).alias("held"), F.lit(-9).alias("at"),
        F.lit(-9).alias("blocked"), F.expr(f"cast(array() as array<{_EVENT}>)").alias("out"),
    )
    path = F.aggregate("series", start, lambda acc, e: F.when(e["day"] == 0, anchor_step(acc, e)).otherwise(close_step(acc, e)), lambda acc: acc["out"])
    return ruled.select(*keys, F.explode(path).alias("e")).select(*keys, "e.*")


def blocked_union(paths: DataFrame) -> DataFrame:
    """(strategy, idx, symbol) that may not be bought at anchor idx: what was stopped in the period before, or sold for
    its age at the anchor before."""
    return paths.filter("kind != 'member'").select("strategy_id", (F.col("idx") + 1).alias("idx"), "symbol").distinct()


def profit_sweep(members: DataFrame, pct: str = "profit_sweep_pct") -> DataFrame:
    """Share of each position kept after sweeping part of its gain at every anchor since entry."""
    gain = F.col("price") / F.col("entry_price") - 1.0
    cut = F.least(F.lit(0.9), F.col(pct) / 100.0 * gain / (1.0 + gain))
    gained = (F.col("held") > 0) & (F.col("price") > F.col("entry_price")) & (F.col("entry_price") != 0)
    w = Window.partitionBy("strategy_id", "symbol", "spell").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(gained, 1.0 - cut).otherwise(1.0)
    return spells(members).withColumn("step", step).withColumn("keep", F.product("step").over(w)).drop("step")


def in_numeraire_reason(rows: DataFrame) -> DataFrame:
    """Why a period is flat: ic, equity, regime or cash (first that applies), null when invested."""
    flat = F.coalesce("gross_notional", _zero()) <= 1e-9
    reason = (
        F.when(F.col("ic_filter") & ~F.coalesce("ic_risk_on", F.lit(True)), "ic")
        .when(F.coalesce("equity_brake", F.lit(False)) & (F.col("equity_trend_exposure") <= 0), "equity")
        .when(~F.coalesce("risk_on", F.lit(True)) & (F.col("regime_exposure") <= 0), "regime")
        .otherwise("cash")
    )
    return rows.withColumn("in_btc", F.when(flat, reason))


def period_flags(positions: DataFrame, strategies: DataFrame, regime: DataFrame, panel: DataFrame, calendar: Calendar) -> DataFrame:
    """(strategy, anchor) with notional, regime and timing flags and the reason of a flat period."""
    frame = calendar.frame(panel.sparkSession).filter("next_anchor is not null").select("frequency", "idx", "anchor")
    notional = positions.groupBy("strategy_id", "idx").agg(F.sum(F.abs("weight")).alias("gross_notional"))
    rows = (
        strategies.join(F.broadcast(frame), "frequency")
        .join(notional, ["strategy_id", "idx"], "left")
        .join(risk_flags(strategies, regime), ["strategy_id", "anchor"], "left")
        .join(ic_flags(panel, calendar, strategies), ["strategy_id", "anchor"], "left")
        .withColumn("equity_brake", F.lit(False))
    )
    return in_numeraire_reason(rows)


def book_state(positions: DataFrame, panel: DataFrame, calendar: Calendar) -> DataFrame:
    """Positions of the last decided anchor with entry, peak over anchors and holding time."""
    last = calendar.frame(panel.sparkSession).agg(F.max("idx")).select("max(idx)").scalar()
    held = positions.filter(F.col("idx") < last)
    runs = spells(held, ("strategy_id", "symbol", "direction"))
    w = Window.partitionBy("strategy_id", "symbol", "direction", "spell").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.withColumn("peak", F.max("price").over(w))
        .filter(F.col("idx") == last - 1)
        .select(
            "strategy_id", "symbol", "direction", F.round("weight", 6).alias("weight"), "score", "entry_anchor",
            "entry_price", F.col("price").alias("last_price"), "peak", F.col("held").alias("periods_held"), "keep",
        )
    )


def book_summary(positions: DataFrame, curve: DataFrame, strategies: DataFrame, regime: DataFrame, panel: DataFrame, calendar: Calendar) -> DataFrame:
    """One row per strategy beside `book_state`: anchor of the last decision, equity, long and short notional, regime and
    timing flags and why the book is flat."""
    last = calendar.frame(panel.sparkSession).agg(F.max("idx")).first()[0]
    flags = period_flags(positions, strategies, regime, panel, calendar).filter(F.col("idx") == last - 1)
    side = lambda sign: F.round(F.coalesce(F.sum(F.when(F.col("weight") * sign > 0, F.col("weight") * sign)), _zero()), 6)
    held = positions.filter(F.col("idx") == last - 1).groupBy("strategy_id").agg(side(1).alias("long_notional"), side(-1).alias("short_notional"))
    equity = curve.groupBy("strategy_id").agg(F.max_by("equity", "idx").alias("equity"))
    rows = flags.select("strategy_id", "anchor", "risk_on", "ic_risk_on", "rolling_ic", "in_btc").join(held, "strategy_id", "left").join(equity, "strategy_id", "left")
    return rows.fillna(0.0, ["long_notional", "short_notional"]).withColumns({"risk_on": F.coalesce("risk_on", F.lit(True)), "ic_risk_on": F.coalesce("ic_risk_on", F.lit(True))})


def weighted_period_return(position_rows: DataFrame) -> DataFrame:
    return position_rows.groupBy("strategy_id", "idx").agg(F.sum(F.col("weight") * F.col("pick_return")).alias("ret"))


def _traded_at(positions: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy, idx, busy, traded): notional traded at an anchor for each size of the longs now and at the anchor before.

    A strategy's longs have one of four sizes, braked or not and locked or not, so the trades under every pair of sizes are
    sums over its symbols: 16 numbers an anchor, and no symbol is needed after them.
    """
    side = lambda d, w: F.when(F.col("direction") == d, w).otherwise(0.0)
    rows = positions.select("strategy_id", "idx", "symbol", side("long", F.col("weight")).alias("l"), side("short", F.col("weight")).alias("s"))
    zero = [_zero().alias(c) for c in ("l", "s")]
    now = rows.select("strategy_id", "idx", "symbol", "l", "s", _zero().alias("l0"), _zero().alias("s0"))
    before = rows.select("strategy_id", (F.col("idx") + 1).alias("idx"), "symbol", *zero, F.col("l").alias("l0"), F.col("s").alias("s0"))
    pairs = now.unionByName(before).groupBy("strategy_id", "idx", "symbol").agg(*[F.sum(c).alias(c) for c in ("l", "s", "l0", "s0")])
    sized = pairs.join(sent(sizes(strategies), limits(strategies).n), "strategy_id")
    change = lambda k, j: F.abs(F.col("l") * F.get("size", F.lit(k)) + F.col("s") - F.col("l0") * F.get("size", F.lit(j)) - F.col("s0"))
    sums = [F.sum(change(k, j)) for k in range(4) for j in range(4)]
    return sized.groupBy("strategy_id", "idx").agg(F.max(F.col("l") != 0).alias("busy"), F.array(*sums).alias("traded"))


def sizes(strategies: DataFrame) -> DataFrame:
    """(strategy, size): of the longs when neither, braked, locked, and both."""
    brake = F.coalesce(clamp(F.col("equity_trend_exposure"), 0.0, 1.0), F.lit(1.0))
    lock = F.coalesce(1.0 - clamp(F.col("profit_lock_pct") / 100.0, 0.0, 0.95), F.lit(1.0))
    return strategies.select("strategy_id", F.array(F.lit(1.0), brake, lock, brake * lock).alias("size"))


def equity_overlays(positions: DataFrame, period_rows: DataFrame, panel: DataFrame, strategies: DataFrame, calendar: Calendar) -> DataFrame:
    """Equity brake and profit lock, which feed a strategy's own equity back into its size.

    The book is reduced to a few numbers per (strategy, period), trades under every pair of sizes included; the recursion
    is a fold over that calendar-sized array of numbers, inside the JVM.
    """
    lived = position_returns(positions, panel, calendar)
    gains = lived.groupBy("strategy_id", "idx").agg(
        F.sum(F.when(F.col("direction") == "long", F.col("weight") * F.col("ret")).otherwise(0.0)).alias("long_ret"),
        F.sum(F.when(F.col("direction") == "short", F.col("weight") * F.col("ret")).otherwise(0.0)).alias("short_ret"),
    )
    base = (
        period_rows.select("strategy_id", "idx", "funding", "fee_pct")
        .join(gains, ["strategy_id", "idx"], "left")
        .join(_traded_at(positions, strategies), ["strategy_id", "idx"], "left")
        .fillna(0.0, ["long_ret", "short_ret"])
        .withColumns({"busy": F.coalesce("busy", F.lit(False)), "traded": F.coalesce("traded", F.array_repeat(_zero(), 16))})
    )
    rows = base.groupBy("strategy_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "long_ret", "short_ret", "funding", "fee_pct", "busy", "traded")), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("rows")
    )
    rules = strategies.select("strategy_id", "equity_trend_exposure", "profit_lock_pct").join(sizes(strategies), "strategy_id")
    joined = rows.join(rules, "strategy_id")
    point = "struct<idx:int,scale:double,brake:boolean,period_return:double,equity:double>"
    start = F.struct(
        F.lit(1.0).alias("equity"),
        F.expr("cast(array() as array<double>)").alias("recent"),
        F.lit(1.0).alias("lock"),
        F.lit(0).alias("size"),
        F.expr(f"cast(array() as array<{point}>)").alias("out"),
    )

    def step(acc, r):
        seen = F.array_append(acc["recent"], acc["equity"])
        recent = F.slice(seen, F.greatest(F.size(seen) - (P.REGIME_SMA_ANCHORS - 1), F.lit(1)), F.lit(P.REGIME_SMA_ANCHORS))
        mean = F.aggregate(recent, _zero(), lambda a, x: a + x) / F.size(recent)
        brake = F.col("equity_trend_exposure").isNotNull() & r["busy"] & (F.size(recent) >= 3) & (acc["equity"] < mean)
        lock = F.col("profit_lock_pct").isNotNull() & r["busy"] & (acc["equity"] >= acc["lock"] * 2.0)
        size = F.when(brake, 1).otherwise(0) + F.when(lock, 2).otherwise(0)
        scale = F.get("size", size)
        net = r["long_ret"] * scale + r["short_ret"] - F.get(r["traded"], size * 4 + acc["size"]) * r["fee_pct"] / 100.0 - r["funding"]
        equity = acc["equity"] * (1.0 + net)
        out = F.struct(r["idx"].alias("idx"), scale.alias("scale"), brake.alias("brake"), net.alias("period_return"), equity.alias("equity"))
        return F.struct(
            equity.alias("equity"),
            recent.alias("recent"),
            F.when(lock, acc["equity"]).otherwise(acc["lock"]).alias("lock"),
            size.alias("size"),
            F.array_append(acc["out"], out).alias("out"),
        )

    return joined.select("strategy_id", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("p")).select(
        "strategy_id", "p.*"
    )
