"""Market tables derived from the provided star-schema tables.

Every derived candle series has one row per (symbol, day): the raw rows of a hot symbol are
folded by a map-side partial aggregate before the shuffle, so a per-symbol window never holds
more rows than the calendar has days. That aggregate hashes (its buffers are plain numbers), so
a task holds one row per symbol and day it meets, not its sorted input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

SYMBOL_EXPRESSIONS = {
    "brand": "p_brand",
    "type": "p_type",
    "brand_type": "p_brand || '-' || p_type",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order(key: str) -> Column:
    """Order key to compare; a missing one comes first, as it does in the trade key."""
    return F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))


def trades(spark: SparkSession, sf_dir: str, symbol: str = "brand", of: DataFrame | None = None) -> DataFrame:
    """One priced trade per line item, keyed by the part's brand and/or type; with `of` (order_key) those of its orders."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    if of is not None:
        line = line.join(of, _order("l_orderkey") == of["order_key"], "left_semi")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.expr(SYMBOL_EXPRESSIONS[symbol]).alias("symbol")
    )
    return line.join(part, "l_partkey").select(
        "symbol",
        F.col("l_shipdate").cast("date").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("px"),
        F.col("l_quantity").cast("double").alias("q"),
        F.col("l_extendedprice").cast("double").alias("ext"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").alias("k"),
    )


def day_folds(rows: DataFrame) -> DataFrame:
    """What plain numbers can say of each day of a symbol: extremes, sums and the order keys at its ends."""
    return rows.groupBy("symbol", "ts").agg(
        F.min(_order("k.l_orderkey")).alias("first_order"),
        F.max(_order("k.l_orderkey")).alias("last_order"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.sum("q").alias("volume"),
        F.sum("ext").alias("notional"),
    )


def candles(spark: SparkSession, sf_dir: str, symbol: str = "brand") -> DataFrame:
    """Daily open/high/low/close/volume/notional per symbol.

    The first pass finds the ends of each day by order key alone; the second takes only the trades of these orders, at
    most two for a symbol and day, and the whole trade key decides among them.
    """
    days = materialize(day_folds(trades(spark, sf_dir, symbol)), "days")
    ends = days.select(F.explode(F.array("first_order", "last_order")).alias("order_key")).distinct()
    at_ends = trades(spark, sf_dir, symbol, ends).groupBy("symbol", "ts")
    edge = at_ends.agg(F.min_by("px", "k").alias("open"), F.max_by("px", "k").alias("close"))
    same = F.col("d.symbol").eqNullSafe(F.col("e.symbol")) & F.col("d.ts").eqNullSafe(F.col("e.ts"))
    return days.alias("d").join(edge.alias("e"), same).select("d.symbol", "d.ts", "open", "high", "low", "close", "volume", "notional")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote series: one row per order date."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("ts"))
        .agg(
            F.max("o_totalprice").cast("double").alias("high"),
            F.min("o_totalprice").cast("double").alias("low"),
            F.avg("o_totalprice").cast("double").alias("close"),
        )
    )


def market_history(candle_rows: DataFrame) -> DataFrame:
    """Sparse archive: Mondays only, cap = running notional, volume = last 30 candles' notional."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return (
        candle_rows.select(
            "symbol",
            "ts",
            F.col("close").alias("price_usd"),
            F.sum("notional").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("market_cap"),
            F.sum("notional").over(w.rowsBetween(-29, 0)).alias("volume_24h"),
        )
        .filter(F.weekday("ts") == 0)
    )


def _is_stable(symbol: Column) -> Column:
    return symbol.rlike("^Brand#13(-|$)")


def _is_delisted(symbol: Column) -> Column:
    return symbol.rlike("^Brand#(4|14)(-|$)")


def coins(candle_rows: DataFrame) -> DataFrame:
    """One identity row per symbol, with the cap and volume of its last candle."""
    w = Window.partitionBy("symbol").orderBy("ts")
    per_symbol = (
        candle_rows.select(
            "symbol", "ts", "close", "notional", F.sum("notional").over(w.rowsBetween(-29, 0)).alias("v30")
        )
        .groupBy("symbol")
        .agg(
            F.min("ts").alias("listing_date"),
            F.max("ts").alias("last_ts"),
            F.max_by("close", "ts").alias("current_price"),
            F.sum("notional").alias("market_cap"),
            F.max_by("v30", "ts").alias("volume_24h"),
        )
    )
    s = F.col("symbol")
    return per_symbol.select(
        "symbol",
        F.concat(F.lit("Asset "), s).alias("name"),
        F.when(~s.rlike("^Brand#22(-|$)"), F.lower(F.regexp_replace(s, "#", "-"))).alias("market_id"),
        "listing_date",
        F.when(_is_delisted(s), F.date_add("last_ts", 1)).alias("delisted_at"),
        (F.col("listing_date") < F.lit("1998-01-01").cast("date")).alias("is_pre_cutoff"),
        _is_stable(s).alias("is_stable"),
        "market_cap",
        "volume_24h",
        "current_price",
        F.col("last_ts").alias("last_updated"),
    )


def watchlist(coin_rows: DataFrame) -> DataFrame:
    """Every fifth symbol; half of them carry an own threshold."""
    s = F.col("symbol")
    return coin_rows.filter(s.rlike("^Brand#(1|6|11|16|21)(-|$)")).select(
        "symbol",
        F.when(s.rlike("^Brand#(6|16)(-|$)"), F.lit(60.0)).alias("threshold_pct"),
        F.col("listing_date").alias("created_at"),
    )
