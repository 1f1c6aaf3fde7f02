"""Rounding and price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(x: Column) -> Column:
    """One decimal, ties to even on the exact binary value.

    ``10 * x`` is formed as ``8x + 2x`` (both exact), so the rounding error of the sum is
    known exactly and decides which side of a tie the true product lies on. Use on a plain
    column reference: the argument is repeated.
    """
    a, b = x * F.lit(8.0), x * F.lit(2.0)
    s = x * F.lit(10.0)
    bb = s - a
    err = (a - (s - bb)) + (b - bb)
    low = F.floor(s).cast("double")
    tie = (s - low) == 0.5
    return F.when(tie & (err > 0), low + 1.0).when(tie & (err < 0), low).otherwise(F.rint(s)) / F.lit(10.0)


def pct_change(now: Column, then: Column) -> Column:
    """Percent change, null when the base is missing or zero."""
    return F.when(then.isNotNull() & (then != 0), (now / then - 1.0) * 100.0)


def distance_pct(price: Column, low: Column) -> Column:
    """Percent above a reference low; zero when either side is missing or zero."""
    missing = price.isNull() | low.isNull() | (price == 0) | (low == 0)
    return F.when(missing, F.lit(0.0)).otherwise((price - low) / low * 100.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def falsy(x: Column) -> Column:
    return x.isNull() | (x == 0)


def steady_sum(x: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows: added as decimals of 20 places. Where a value or the
    sum needs more than 18 whole digits, or is not a number, it is the plain sum."""
    places = x.try_cast("decimal(38,20)")
    return F.coalesce(F.when(F.count(x) == F.count(places), F.try_sum(places).cast("double")), F.sum(x))


def steady_avg(x: Column) -> Column:
    return steady_sum(x) / F.nullif(F.count(x), F.lit(0))
