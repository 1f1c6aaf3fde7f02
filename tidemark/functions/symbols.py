"""Symbol and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pegged assets by base symbol, and the words that mark one in a name.
STABLE_SYMBOLS = [
    "DAI", "U", "USTC", "FRAX", "GUSD", "LUSD", "SUSD", "TUSD", "BUSD", "USDP", "USDD", "USDR", "PYUSD",
    "FDUSD", "EURS", "EURT", "EURC", "CEUR", "AGEUR", "XAUT", "PAXG", "KAU", "XAUM", "ALUSD", "MIM", "CUSD",
    "USDX", "USDY",
]
STABLE_NAME_PATTERN = r"\b(usd|stables?|stablecoin|dollar|gold|euro)\b"
# Bases never tracked as a pair, leveraged suffixes and fiat bases.
STABLE_BASES = [
    "USDC", "BUSD", "TUSD", "USDP", "DAI", "FDUSD", "USDE", "USD1", "XUSD", "USDY", "BFUSD", "EUR", "EURI",
    "AEUR", "GBP", "TRY", "BRL", "ARS", "BIDR", "IDRT", "BKRW", "NGN", "RUB", "UAH", "ZAR",
]
EXCLUDED_BASES = ["BTC", "WBTC"]
LEVERAGED_SUFFIXES = ["UP", "DOWN", "BULL", "BEAR"]
FIAT_BASES = ["AUD", "BRL", "EUR", "GBP", "IDRT", "RUB", "TRY", "UAH", "USD", "ZAR"]
# Score buckets, highest first.
VERDICTS = [
    (95, "CHEAPEST 5% OF TRACKED ALTS"),
    (80, "CHEAPEST 20% OF TRACKED ALTS"),
    (50, "CHEAPER THAN THE MEDIAN ALT"),
    (20, "EXPENSIVE HALF OF TRACKED ALTS"),
]
VERDICT_LOWEST = "AMONG THE MOST EXPENSIVE ALTS"
VERDICT_NONE = "NOT ENOUGH HISTORY FOR A SCORE YET"


def quote_asset(symbol: Column) -> Column:
    """USDT before BTC; null when the symbol carries neither suffix (or nothing else)."""
    for_usdt = symbol.endswith("USDT")
    return F.when(for_usdt, "USDT").when(symbol.endswith("BTC"), "BTC")


def base_asset(symbol: Column) -> Column:
    return (
        F.when(symbol.endswith("USDT"), F.regexp_replace(symbol, "USDT$", ""))
        .when(symbol.endswith("BTC"), F.regexp_replace(symbol, "BTC$", ""))
        .otherwise(symbol)
    )


def looks_pegged(base: Column, name: Column) -> Column:
    upper = F.upper(base)
    by_symbol = upper.isin(STABLE_SYMBOLS) | upper.contains("USD")
    by_name = F.coalesce(name.rlike("(?i)" + STABLE_NAME_PATTERN), F.lit(False))
    return F.coalesce(base != "", F.lit(False)) & (by_symbol | by_name)


def verdict(score: Column) -> Column:
    chain = F.when(score.isNull(), VERDICT_NONE)
    for floor, label in VERDICTS:
        chain = chain.when(score >= floor, label)
    return chain.otherwise(VERDICT_LOWEST)
