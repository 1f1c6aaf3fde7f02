"""Quantile conventions over an ascending array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(ordered: Column, zero_based: Column) -> Column:
    return F.element_at(ordered, (zero_based + 1).cast("int"))


def nearest_lower(ordered: Column, q: float) -> Column:
    """Index floor(q * (n - 1))."""
    return _at(ordered, F.floor(F.lit(q) * (F.size(ordered) - 1)))


def lower_quarter(ordered: Column) -> Column:
    """Index max(0, floor(n / 4) - 1)."""
    return _at(ordered, F.greatest(F.lit(0), F.floor(F.lit(0.25) * F.size(ordered)) - 1))


def position_quantile(ordered: Column, q: float) -> Column:
    """Index min(n - 1, floor(q * n))."""
    return _at(ordered, F.least(F.size(ordered) - 1, F.floor(F.lit(q) * F.size(ordered))))


def median(ordered: Column) -> Column:
    """Middle value, mean of the two middle values for an even count."""
    n = F.size(ordered)
    return (_at(ordered, F.floor((n - 1) / 2)) + _at(ordered, F.floor(n / 2))) / 2.0


def count_le(ordered: Column, value: Column) -> Column:
    """How many entries are <= value, where value is itself an entry."""
    equal = F.size(ordered) - F.size(F.array_remove(ordered, value))
    return F.array_position(ordered, value) - 1 + equal
