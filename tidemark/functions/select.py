"""Exact order statistics of a column of any size by refinement of ranges.

A pass cuts the values into parts of nearly equal depth (splitters from a mergeable sketch), counts the rows of every part,
and goes on inside the parts the wanted positions fall into, until such a part is a single value or few enough rows to
sort. Each pass keeps about a sixtieth of the rows; only counts and splitters reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

FEW = 20_000  # rows that are sorted in one task
PARTS = 64


def order_statistics(df: DataFrame, value: str, positions: Sequence[int]) -> list[float]:
    """The values at 0-based `positions` of the non-null rows in ascending order; the column has no NaN."""
    return _at(_column(df, value), positions)


def _column(df: DataFrame, value: str) -> DataFrame:
    """The one column, written: every pass reads it."""
    return materialize(df.select((F.col(value).cast("double") + F.lit(0.0)).alias("v")).filter(F.col("v").isNotNull()), "column")


def _at(rows: DataFrame, positions: Sequence[int]) -> list[float]:
    found = _select(rows, rows.count(), sorted(set(positions)))
    return [found[p] for p in positions]


def _select(rows: DataFrame, n: int, positions: list[int]) -> dict[int, float]:
    if not all(0 <= p < n for p in positions):
        raise IndexError(positions)
    if n <= FEW:
        ordered = rows.agg(F.sort_array(F.collect_list("v")).alias("v"))
        return dict(zip(positions, ordered.select(*[F.element_at("v", p + 1) for p in positions]).first()))
    fractions = F.array(*[F.lit(k / PARTS) for k in range(PARTS + 1)])
    cuts = sorted(set(rows.select(F.percentile_approx("v", fractions, F.lit(20 * PARTS))).first()[0]))
    # Odd parts equal a cut, even ones lie between two. A cut is a value of the column, so every part is smaller than all.
    array = F.array(*[F.lit(c) for c in cuts])
    part = (2 * F.size(F.filter(array, lambda c: c < F.col("v"))) + F.array_contains(array, F.col("v")).cast("int")).cast("int")
    sizes = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found: dict[int, float] = {}
    before = 0
    for k in sorted(sizes):
        mine = [p for p in positions if before <= p < before + sizes[k]]
        if mine and k % 2:
            found.update(dict.fromkeys(mine, cuts[k // 2]))
        elif mine:
            inner = _select(rows.filter(part == k), sizes[k], [p - before for p in mine])
            found.update({p: inner[p - before] for p in mine})
        before += sizes[k]
    return found


def quantiles(df: DataFrame, value: str, wanted: Sequence[float]) -> list[float | None]:
    """Quantiles, linear between neighbours at position q * (n - 1); None without rows."""
    rows = _column(df, value)
    n = rows.count()
    if not n:
        return [None] * len(wanted)
    at = [q * (n - 1) for q in wanted]
    places = [p for x in at for p in (math.floor(x), math.ceil(x))]
    found = _at(rows, places)
    return [low + (high - low) * (x - math.floor(x)) for x, low, high in zip(at, found[::2], found[1::2])]
