"""Decoding of landed payloads into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROSECOND_FLOOR = 10**14
CANDLE_FIELDS = ("open", "high", "low", "close", "volume")


def decode_kline_arrays(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Rows ``[open_ms, "open", "high", "low", "close", "volume", ...]`` as JSON text into candles."""
    cells = F.from_json(F.col(column), T.ArrayType(T.StringType()))
    rows = payload.select("symbol", cells.alias("c"))
    return rows.select(
        "symbol",
        F.timestamp_millis(F.element_at("c", 1).cast("long")).cast("date").alias("ts"),
        *[F.element_at("c", i + 2).cast("double").alias(f) for i, f in enumerate(CANDLE_FIELDS)],
    )


def scan_monthly_csv(spark: SparkSession, path: str) -> DataFrame:
    """Monthly candle files: header and blank lines skipped, microsecond times read as milliseconds.

    The symbol is taken from the file's folder (``symbol=...``).
    """
    schema = "open_time string, open double, high double, low double, close double, volume double, symbol string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    moment = F.trim("open_time").cast("long")
    millis = F.when(moment > MICROSECOND_FLOOR, F.floor(moment / 1000)).otherwise(moment)
    return raw.filter(F.trim("open_time").rlike(r"^\d+$")).select(
        "symbol", F.timestamp_millis(millis.cast("long")).cast("date").alias("ts"), *CANDLE_FIELDS
    )


def decode_market_chart(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Three arrays of [ms, value] into one row per day.

    The last price of a day wins; cap and volume are those at exactly the same millisecond;
    zero and missing values are dropped. Matching by key happens inside the symbol's own payload.
    """
    pair = "array<array<double>>"
    parsed = payload.select(
        "symbol",
        F.from_json(column, f"prices {pair}, market_caps {pair}, total_volumes {pair}").alias("j"),
    )

    def long_form(field: str, name: str) -> DataFrame:
        points = parsed.select("symbol", F.explode(f"j.{field}").alias("p"))
        value = F.element_at("p", 2)
        return points.filter(value.isNotNull() & (value != 0)).select(
            "symbol", F.element_at("p", 1).cast("long").alias("ms"), value.alias(name)
        )

    # The three series have the same keys: tag, union and fold instead of joining.
    tagged = (
        long_form("prices", "price_usd")
        .unionByName(long_form("market_caps", "market_cap"), allowMissingColumns=True)
        .unionByName(long_form("total_volumes", "volume_24h"), allowMissingColumns=True)
    )
    names = ("price_usd", "market_cap", "volume_24h")
    moments = tagged.groupBy("symbol", "ms").agg(*[F.max(n).alias(n) for n in names]).filter("price_usd is not null")
    day = F.timestamp_millis("ms").cast("date")
    return (
        moments.groupBy("symbol", day.alias("ts"))
        .agg(F.max_by(F.struct(*names), "ms").alias("r"))
        .select("symbol", "ts", *[F.col(f"r.{n}").alias(n) for n in names])
    )


def decode_id_list(payload: DataFrame, column: str = "payload", most: int | None = None) -> DataFrame:
    """(symbol, id) candidates: lower-cased symbol, distinct, numbered in arrival order (``seq``).

    ``most`` keeps the first so many of a symbol, for providers that take no more.
    """
    parsed = payload.select("seq", F.from_json(column, "id string, symbol string").alias("j"))
    rows = parsed.select(F.lower("j.symbol").alias("symbol"), F.col("j.id").alias("id"), "seq")
    rows = rows.filter((F.coalesce("symbol", F.lit("")) != "") & (F.coalesce("id", F.lit("")) != ""))
    distinct = rows.groupBy("symbol", "id").agg(F.min("seq").alias("seq"))
    placed = distinct.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("seq")))
    return placed if most is None else placed.filter(F.col("place") <= most)


def load_score_artifact(spark: SparkSession, path: str, version: str, required: list[str]) -> DataFrame:
    """Weights of a stored model as (name, weight, mean, scale, direction) rows.

    Raises when the version differs or a required weight is missing.
    """
    numbers, scaling = T.MapType(T.StringType(), T.DoubleType()), T.StructType()
    scaling = scaling.add("mean", "double").add("scale", "double")
    schema = (
        T.StructType()
        .add("version", "string")
        .add("weights", numbers)
        .add("feature_scaling", T.MapType(T.StringType(), scaling))
        .add("feature_directions", T.MapType(T.StringType(), T.IntegerType()))
    )
    artifact = spark.read.schema(schema).json(path, multiLine=True)
    rows = artifact.select("version", "feature_scaling", "feature_directions", F.explode("weights").alias("name", "weight"))
    found = rows.agg(F.first("version").alias("v"), F.collect_set("name").alias("names")).first()
    if found["v"] != version:
        raise ValueError(f"artifact declares version {found['v']!r}, not {version!r}")
    missing = sorted(set(required) - set(found["names"]))
    if missing:
        raise ValueError(f"artifact {version} lacks weights for {', '.join(missing)}")
    scale = F.element_at("feature_scaling", F.col("name"))
    return rows.select(
        "name",
        "weight",
        F.coalesce(scale["mean"], F.lit(0.0)).alias("mean"),
        F.coalesce(scale["scale"], F.lit(1.0)).alias("scale"),
        F.coalesce(F.element_at("feature_directions", F.col("name")), F.lit(1)).alias("direction"),
    )
