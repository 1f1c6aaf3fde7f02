"""Exact ranks inside groups of any size.

A cross-section of up to `WHOLE` rows is ranked by windows in one task, all its columns after one shuffle. Larger ones are
cut: a mergeable quantile sketch gives splitters of nearly equal depth, rows between two splitters are ranked by a
window of their own, rows equal to a splitter need only be counted, and prefix sums of the counts place the ranges. Splitters
are values of the data and ranges are monotone, so ranks are exact however the values lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

WHOLE = 200_000  # rows of a cross-section that one task ranks
RANGES = 64  # equal parts a larger cross-section is cut into
SALTS = 32  # parts of the rows that equal one splitter, which need no order


def fits(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether no group has more than WHOLE rows: one count per group, one number to the driver."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= WHOLE


def splitters(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per group the ascending splitters of every column, as arrays ``<value>_cuts``; written, so that its size is known."""
    parts = [F.lit(k / RANGES) for k in range(1, RANGES)]
    cuts = [F.array_sort(F.array_distinct(F.percentile_approx(v, F.array(*parts), F.lit(20 * RANGES)))).alias(f"{v}_cuts") for v in values]
    return materialize(df.groupBy(*by).agg(*cuts), "splitters")


def range_of(value: Column, cuts: Column) -> Column:
    """Even numbers lie between two splitters, odd ones are the rows equal to a splitter."""
    cuts = F.coalesce(cuts, F.array().cast("array<double>"))
    return 2 * F.size(F.filter(cuts, lambda c: c < value)) + F.array_contains(cuts, value).cast("int")


def offsets(counts: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """From (by, __r, n) the rows below each range and of the whole group: a few rows per group, written."""
    across, whole = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sums = counts.groupBy(*by, "__r").agg(F.sum(n).alias("__rn"))
    placed = sums.select(*by, "__r", "__rn", F.coalesce(F.sum("__rn").over(across), F.lit(0)).alias("__off"), F.sum("__rn").over(whole).alias("total"))
    return materialize(placed, "offsets")


def count_before(counts: DataFrame, by: Sequence[str], value: str, n: str = "n", whole: bool | None = None) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` per group to distinct-value counts. `whole` tells
    whether each group may be one task; measured if not given."""
    by = list(by)
    if whole or (whole is None and fits(counts, by)):
        w = Window.partitionBy(*by)
        below = F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumns({"before": F.coalesce(below, F.lit(0)), "total": F.sum(n).over(w)})
    number = F.col(value).cast("double")
    cuts = splitters(counts.select(*by, number.alias("__v")), by, ["__v"])
    ranged = counts.join(cuts, by, "left").withColumn("__r", range_of(number, F.col("__v_cuts"))).drop("__v_cuts")
    inside = Window.partitionBy(*by, "__r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return within.join(offsets(ranged, by, n), [*by, "__r"]).withColumn("before", F.col("__in") + F.col("__off")).drop("__r", "__rn", "__in", "__off")


def average_rank(value: str | Column, by: Sequence[str]) -> Column:
    """0-based average rank inside a group that is one task: half of the rows below and not above, less one."""
    w = Window.partitionBy(*by).orderBy(value)
    return (F.rank().over(w) + F.count(F.lit(1)).over(w) - 2) / 2.0


def _cut_ranks(df: DataFrame, by: list[str], ids: list[str], values: list[str], keep: list[str]) -> DataFrame:
    """`rank_columns` for groups that are cut. Two shuffles of the rows: by range, and back by id."""
    cuts = splitters(df, by, values)
    pairs = F.array(*[F.struct(F.lit(i).alias("__c"), F.col(v).alias("__v"), F.col(f"{v}_cuts").alias("__cuts")) for i, v in enumerate(values)])
    long = df.join(cuts, by).select(*by, *ids, *keep, F.explode(pairs).alias("__p")).select(*by, *ids, *keep, "__p.__c", "__p.__v", range_of(F.col("__p.__v"), F.col("__p.__cuts")).alias("__r"))
    keys = [*by, "__c"]
    places = offsets(long.select(*keys, "__r", F.lit(1).alias("n")), keys, "n")
    equal = F.col("__r") % 2 == 1
    salted = long.withColumn("__s", F.when(equal, F.pmod(F.xxhash64(*ids), F.lit(SALTS))).otherwise(0))
    inner = salted.withColumn("__in", average_rank("__v", [*keys, "__r", "__s"]))
    placed = inner.join(places, [*keys, "__r"])
    rank = F.col("__off") + F.when(equal, (F.col("__rn") - 1) / 2.0).otherwise(F.col("__in"))
    return placed.groupBy(*by, *ids).agg(
        *[F.first(k).alias(k) for k in keep],
        *[F.max(F.when(F.col("__c") == i, rank)).alias(f"{v}_rank") for i, v in enumerate(values)],
        F.max("total").alias("group_n"),
    )


def rank_columns(
    df: DataFrame, by: Sequence[str], ids: Sequence[str], values: Sequence[str], keep: Sequence[str] = (), whole: bool | None = None
) -> DataFrame:
    """Average rank (0-based, ties share the mean position) of every column in ``values``, none of them null.

    Returns by + ids + keep, one ``<value>_rank`` per column and ``group_n``. `whole` tells whether each group may be one
    task (`fits`); measured if not given.
    """
    by, ids, keep, values = list(by), list(ids), list(keep), list(values)
    # Both zeros are one value.
    rows = df.select(*by, *ids, *keep, *[(F.col(v).cast("double") + F.lit(0.0)).alias(v) for v in values if v not in keep])
    if not (fits(rows, by) if whole is None else whole):
        return _cut_ranks(rows, by, ids, values, keep)
    ranks = [average_rank(v, by).alias(f"{v}_rank") for v in values]
    return rows.select(*by, *ids, *keep, *ranks, F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("group_n"))


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add `name`, the 0-based place of each row in the order, for tables of any size.

    Rows are range-sorted and written with a running id; the first id and the size of each partition, a few rows, turn it
    into a place without gaps.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__row", 33))
    blocks = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__shift"))
    return placed.join(F.broadcast(shifts), "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def to_percentile(rank0: Column, n: Column, scale: float = 100.0) -> Column:
    """Average rank scaled to 0..scale; the middle of the scale for a single row."""
    return F.when(n > 1, scale * rank0 / (n - 1)).otherwise(scale / 2.0)


def rank_percentiles(df: DataFrame, by: Sequence[str], ids: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-rank percentile 0-100 of one column inside each group."""
    ranked = rank_columns(df, by, ids, [value])
    return ranked.select(*by, *ids, to_percentile(F.col(f"{value}_rank"), F.col("group_n")).alias(out))
