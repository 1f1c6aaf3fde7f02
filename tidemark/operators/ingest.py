"""Universe maintenance: pairs, listings, delistings, identifiers, price checks, conversion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions import symbols as S
from tidemark.functions.numeric import falsy
from tidemark.functions.ranks import number_rows


def split_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.withColumns({"base": S.base_asset(F.col(column)), "quote": S.quote_asset(F.col(column))})


def convert_to_numeraire(candles: DataFrame, rates: DataFrame) -> DataFrame:
    """Quote-priced candles into the numeraire with the day's conservative bounds.

    Days without a usable rate are dropped. The rate table has one row per day; Spark picks the
    join by its size.
    """
    usable = rates.filter(~falsy(F.col("high")) & ~falsy(F.col("low")) & ~falsy(F.col("close")))
    r = usable.select("ts", F.col("high").alias("rh"), F.col("low").alias("rl"), F.col("close").alias("rc"))
    return candles.join(r, "ts").select(
        "symbol",
        "ts",
        (F.col("open") / F.col("rc")).alias("open"),
        (F.col("high") / F.col("rl")).alias("high"),
        (F.col("low") / F.col("rh")).alias("low"),
        (F.col("close") / F.col("rc")).alias("close"),
        (F.col("volume") * F.col("close") / F.col("rc")).alias("volume"),
    )


def stable_flags(coins: DataFrame, category_ids: DataFrame) -> DataFrame:
    """Pegged when the id is in a pegged category, or the base or name says so."""
    flagged = category_ids.select(F.col("id").alias("market_id")).distinct().withColumn("__in", F.lit(True))
    by_id = F.coalesce("__in", F.lit(False))
    return (
        coins.join(flagged, "market_id", "left")
        .withColumn("is_stable", by_id | S.looks_pegged(S.base_asset(F.col("symbol")), F.col("name")))
        .drop("__in")
    )


def category_flags(coins: DataFrame, category_ids: DataFrame) -> DataFrame:
    flagged = category_ids.select(F.col("id").alias("market_id")).distinct().withColumn("__in", F.lit(True))
    return coins.join(flagged, "market_id", "left").withColumn("in_category", F.coalesce("__in", F.lit(False))).drop("__in")


def tracked_universe(coins: DataFrame, min_cap: float = P.MIN_TRACKED_CAP) -> DataFrame:
    return coins.filter(F.col("delisted_at").isNull() & (F.col("is_pre_cutoff") | (F.col("market_cap") >= min_cap)))


def preferred_pairs(pairs: DataFrame) -> DataFrame:
    """One tradable pair per base: the BTC quote first, otherwise the first seen.

    A fold with ``min_by`` instead of a ranking window, so one base with many pairs stays cheap.
    """
    tradable = pairs.filter(
        (F.col("status") == "TRADING")
        & F.col("quote").isin("BTC", "USDT")
        & (F.col("base") != "")
        & ~F.col("base").isin(S.STABLE_BASES + S.EXCLUDED_BASES)
    )
    order = F.struct((F.col("quote") != "BTC").cast("int"), "seq")
    best = tradable.groupBy("base").agg(F.min_by(F.struct("symbol", "quote"), order).alias("r"))
    return best.select("base", "r.symbol", "r.quote")


def discover_delisted(
    mirror: DataFrame, active: DataFrame, excluded: list[str] | None = None
) -> DataFrame:
    """Mirror symbols that are no longer active, one preferred pair per base.

    Dropped: excluded and fiat bases, active bases, leveraged suffixes on an active base, and
    bases that contain an active base of three or more letters. Containment is an equality join
    on the substrings of the base, not a comparison of every pair.
    """
    blocked = [b.upper() for b in (excluded if excluded is not None else S.STABLE_BASES + S.EXCLUDED_BASES)]
    quoted = F.col("quote").isin("BTC", "USDT")
    live = split_symbols(active.select("symbol").distinct()).filter(quoted)
    live_bases = live.select(F.upper("base").alias("part")).distinct()
    rows = (
        split_symbols(mirror.select("symbol").distinct())
        .filter(quoted & (F.col("base") != ""))
        .withColumn("base", F.upper("base"))
        .filter(~F.col("base").isin(blocked + S.FIAT_BASES))
        .join(active.select("symbol").distinct(), "symbol", "left_anti")
    )
    length = F.length("base")
    starts = F.sequence(F.lit(1), length)
    pieces = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.filter(starts, lambda n: (n >= 3) & (i + n - 1 <= length)), lambda n: F.substring(F.col("base"), i, n)
            ),
        )
    )
    stems = F.array_compact(
        F.array(
            *[
                F.when(F.col("base").endswith(s), F.expr(f"substring(base, 1, length(base) - {len(s)})"))
                for s in S.LEVERAGED_SUFFIXES
            ]
        )
    )
    parts = F.array_union(F.array_union(F.array("base"), stems), pieces)
    hit = (
        rows.select("base").distinct().select("base", F.explode(parts).alias("part"))
        .join(live_bases, "part", "left_semi").select("base").distinct()
    )
    order = F.struct((F.col("quote") != "BTC").cast("int"), "symbol")
    kept = rows.join(hit, "base", "left_anti")
    return kept.groupBy("base").agg(F.min_by("symbol", order).alias("symbol"))


def new_listings(live: DataFrame, coins: DataFrame, candles: DataFrame, cutoff: dt.date) -> DataFrame:
    """Live pairs not yet known: listing date is the first candle; pairs without candles are skipped."""
    first = candles.groupBy("symbol").agg(F.min("ts").alias("listing_date"))
    fresh = live.select("symbol").distinct().join(coins.select("symbol"), "symbol", "left_anti")
    return fresh.join(first, "symbol").withColumn("is_pre_cutoff", F.col("listing_date") < F.lit(cutoff))


def delist_archive(coins: DataFrame, live: DataFrame, now: dt.date) -> DataFrame:
    """Mark symbols that vanished from the live list, clear the mark of those that returned."""
    seen = live.select("symbol").distinct().withColumn("__live", F.lit(True))
    joined = coins.join(seen, "symbol", "left")
    is_live = F.coalesce("__live", F.lit(False))
    action = (
        F.when(is_live & F.col("delisted_at").isNotNull(), "restored")
        .when(~is_live & F.col("delisted_at").isNull(), "archived")
        .otherwise("unchanged")
    )
    until = F.when(is_live, F.lit(None).cast("date")).otherwise(F.coalesce("delisted_at", F.lit(now)))
    return joined.withColumn("action", action).withColumn("delisted_at", until).drop("__live")


def ingest_plan(coins: DataFrame, candles: DataFrame) -> DataFrame:
    """Per symbol the stored range, whether it must be refetched and where to resume."""
    stored = candles.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    late = F.col("first_ts") > F.date_add("listing_date", P.BACKFILL_TOLERANCE_DAYS)
    needs = F.col("first_ts").isNull() | F.coalesce(late, F.lit(False))
    return (
        coins.select("symbol", "listing_date")
        .join(stored, "symbol", "left")
        .withColumn("needs_backfill", needs)
        .withColumn("resume_from", F.when(~F.col("needs_backfill"), F.col("last_ts")))
    )


def resolve_ids(coins: DataFrame, candidates: DataFrame, prices: DataFrame, caps: DataFrame) -> DataFrame:
    """One id per symbol among its candidates.

    Candidates priced within twice the tolerance of the symbol's own price come first, larger
    caps before smaller, then candidate order. The choice is a ``min_by`` fold.
    """
    tolerance = P.PRICE_TOLERANCE_PCT * 2
    joined = (
        candidates.join(coins.select("symbol", "current_price"), "symbol")
        .join(prices.select("id", F.col("price").alias("ref")), "id", "left")
        .join(caps.select("id", F.col("cap")), "id", "left")
    )
    usable = ~falsy(F.col("current_price")) & ~falsy(F.col("ref"))
    gap = F.abs(F.col("ref") - F.col("current_price")) / F.col("current_price") * 100
    match = F.coalesce(usable & (gap <= tolerance), F.lit(False))
    order = F.struct((~match).cast("int"), -F.coalesce("cap", F.lit(-1.0)), "place")
    best = joined.groupBy("symbol").agg(
        F.min_by(F.struct("id", match.alias("by_price")), order).alias("r"), F.count(F.lit(1)).alias("candidates")
    )
    return best.select("symbol", "r.id", "r.by_price", "candidates")


def verify_prices(coins: DataFrame, reference: DataFrame, tolerance: float = P.PRICE_TOLERANCE_PCT) -> DataFrame:
    """Deviation from a reference price in percent; unknown (null) without a usable reference."""
    wanted = coins.filter(
        F.col("current_price").isNotNull() & F.col("market_id").isNotNull() & F.col("delisted_at").isNull()
    )
    joined = wanted.join(reference.select(F.col("id").alias("market_id"), F.col("price").alias("ref")), "market_id", "left")
    usable = ~falsy(F.col("ref")) & ~falsy(F.col("current_price"))
    deviation = F.abs(F.col("ref") - F.col("current_price")) / F.col("current_price") * 100
    return joined.select(
        "symbol",
        F.when(usable, F.round(deviation, 2)).alias("deviation_pct"),
        F.when(usable, deviation <= tolerance).alias("verified"),
    )


def apply_metadata(coins: DataFrame, markets: DataFrame) -> DataFrame:
    """Name, cap and volume from market rows; a blank name keeps the old one."""
    m = markets.select(
        F.col("id").alias("market_id"),
        F.col("name").alias("__name"),
        F.col("cap").alias("__cap"),
        F.col("volume").alias("__vol"),
        F.lit(True).alias("__hit"),
    )
    joined = coins.join(m, "market_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.withColumns(
        {
            "name": F.coalesce(F.nullif(F.col("__name"), F.lit("")), F.col("name")),
            "market_cap": F.when(hit, F.col("__cap")).otherwise(F.col("market_cap")),
            "volume_24h": F.when(hit, F.col("__vol")).otherwise(F.col("volume_24h")),
        }
    ).drop("__name", "__cap", "__vol", "__hit")


def delisted_backfill(
    candles: DataFrame, coins: DataFrame, rates: DataFrame, since: dt.date, cutoff: dt.date
) -> tuple[DataFrame, DataFrame]:
    """Archived coin rows of recovered symbols and a one-row summary.

    USDT-quoted candles are converted first; a symbol left without candles counts as failed.
    """
    recent = split_symbols(candles.filter(F.col("ts") >= F.lit(since)))
    usdt = F.coalesce(F.col("quote") == "USDT", F.lit(False))
    converted = convert_to_numeraire(recent.filter(usdt).drop("base", "quote"), rates)
    native = recent.filter(~usdt).select(*converted.columns)
    kept = native.unionByName(converted)
    months = recent.groupBy("symbol").agg(F.countDistinct(F.trunc("ts", "MM")).alias("months"))
    seen = kept.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows")
    )
    known = coins.select("symbol", F.col("listing_date").alias("__listed"))
    archived = (
        months.join(seen, "symbol", "left")
        .join(known, "symbol", "left")
        .select(
            "symbol",
            F.coalesce("__listed", "first_ts").alias("listing_date"),
            (F.col("first_ts") < F.lit(cutoff)).alias("is_pre_cutoff"),
            F.date_add("last_ts", 1).alias("delisted_at"),
            "months",
            F.coalesce("rows", F.lit(0)).alias("rows"),
        )
    )
    ok = F.col("rows") > 0
    summary = archived.agg(
        F.count_if(ok).alias("coins"),
        F.coalesce(F.sum(F.when(ok, F.col("months"))), F.lit(0)).alias("months"),
        F.sum("rows").alias("rows"),
        F.count_if(~ok).alias("failed"),
    )
    return archived.filter(ok), summary


def demo_candles(coins: DataFrame, start: dt.date, days: int) -> DataFrame:
    """Deterministic candles per coin: a sine wave on a linear decline from its base price.

    ``coins`` has symbol and base_price; the phase follows the symbol order.
    """
    indexed = number_rows(coins.select("symbol", "base_price"), ["symbol"], "i")
    rows = indexed.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("d"))
    wave = 1 + 0.35 * F.sin((F.col("d") + F.col("i") * 10) / 18)
    close = F.col("base_price") * wave * (1 - F.col("d") / (days * 2))
    return rows.select(
        "symbol",
        F.date_add(F.lit(start), F.col("d")).alias("ts"),
        close.alias("open"),
        (close * 1.02).alias("high"),
        (close * 0.97).alias("low"),
        close.alias("close"),
        F.lit(1000.0).alias("volume"),
    )


def demo_rates(spark, start: dt.date, days: int) -> DataFrame:
    close = 60000.0 * (1 + 0.15 * F.sin(F.col("id") / 40))
    return spark.range(days).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("ts"),
        (close * 1.01).alias("high"),
        (close * 0.99).alias("low"),
        close.alias("close"),
    )
