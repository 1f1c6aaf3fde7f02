"""Report and export writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The column names of the export.
BOARD_CSV_COLUMNS = [
    "symbol", "base_asset", "name", "listing_date", "current_price", "price_7d_ago", "price_30d_ago", "market_cap",
    "volume_24h", "event_low", "all_time_low", "distance_pct_event", "distance_pct_atl", "price_verified",
    "price_deviation_pct", "valuation_pct_1y", "valuation_pct_3y", "valuation_pct_all", "median_dist_1y",
    "median_dist_3y", "range_position", "days_since_atl", "basing_pct_90d", "trend_30d_pct", "trend_90d_pct",
    "value_score",
]


def write_features_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, null fields kept."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_board_csv(board: DataFrame, path: str) -> None:
    """26 fixed columns with a header; quotes are doubled, empty text for null."""
    out = board.select(*[F.col(c).cast("string").alias(c) for c in BOARD_CSV_COLUMNS])
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "nullValue", ""
    ).csv(path)


def write_curve_csv(curve: DataFrame, path: str) -> None:
    """Date and values with six decimals, one folder per strategy."""
    values = ["equity", "equity_usd", "benchmark_usd", "period_return"]
    out = curve.select(
        "strategy_id", F.col("anchor").cast("string").alias("date"), *[F.format_string("%.6f", F.col(c)).alias(c) for c in values]
    )
    out.write.mode("overwrite").partitionBy("strategy_id").option("header", True).csv(path)


def tidy_report(sections: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(section, metric, value) rows from one-row results."""
    parts = []
    for section, row in sections:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])
        parts.append(row.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
