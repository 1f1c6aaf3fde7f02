"""Keyed writes: upserts, first/last row per key and change counts.

All of them fold with aggregates that combine on the map side, so many copies of one key never
meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Column | str, how) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(how(F.struct(*rest), order).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """One row per key, the one with the lowest order value."""
    return _pick(df, keys, order, F.min_by)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert or overwrite on the key; running it twice changes nothing.

    ``incoming`` holds one row per key (fold repeats with :func:`last_per_key` first).
    """
    tagged = stored.withColumn("__arrival", F.lit(0)).unionByName(
        incoming.select(*stored.columns).withColumn("__arrival", F.lit(1))
    )
    return last_per_key(tagged, keys, "__arrival").select(*stored.columns)


def remove_keys(stored: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def change_actions(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key what an upsert would do: inserted, updated, unchanged or kept."""
    values = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*values).alias("old"))
    new = incoming.select(*keys, F.struct(*values).alias("new"))
    action = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "inserted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "updated")
        .otherwise("unchanged")
    )
    return old.join(new, list(keys), "full").select(*keys, action.alias("action"))


def change_counts(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return change_actions(stored, incoming, keys).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def write_by_year(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Store a series partitioned by year, replacing only the years present in ``df``."""
    (
        df.withColumn("year", F.year(ts))
        .repartition("year")
        .sortWithinPartitions("symbol", ts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def scan_candles(candles: DataFrame, symbols: DataFrame | None = None, end=None, columns: Sequence[str] = ()) -> DataFrame:
    """Pruned scan: wanted columns, ``ts <= end`` and a symbol set (semi join)."""
    rows = candles.select(*columns) if columns else candles
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end))
    if symbols is not None:
        rows = rows.join(symbols.select("symbol"), "symbol", "left_semi")
    return rows
