"""Sources, sinks and universe maintenance (sections A, B and C of the inventory)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import EVENT, query
from catalog.sqlbase import CTES
from tidemark.functions import symbols as S
from tidemark.operators import ingest as I
from tidemark.session import materialize, shared_dir
from tidemark.sources import payloads, sinks, tables
from tidemark.sources.store import PartitionedTable

OHLCV = "symbol:s ts:d open:f8 high:f8 low:f8 close:f8 volume:f6"
D2000 = dt.date(2000, 1, 1)


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _out(ws, name: str) -> str:
    import uuid

    return f"{shared_dir(ws.spark)}/{name}-{uuid.uuid4().hex}"


# --- derived inputs -------------------------------------------------------------------------
# Exchange pairs come from the part table: the base from the words of the name, the quote from
# the size, the status from the price. Active pairs are those of the small parts.
PAIR_SQL = """
SELECT p_partkey AS seq, base, quote, base || quote AS symbol, status, p_type, p_retailprice AS price FROM (
  SELECT *, CASE WHEN p_size <= 3 THEN 'USDC' WHEN p_size <= 6 THEN 'GBP' WHEN p_size <= 10 THEN w2 || 'UP'
                 WHEN p_size <= 15 THEN w1 || w2 WHEN p_size <= 20 THEN w1 ELSE w2 || CAST(p_size AS VARCHAR) END AS base,
    CASE WHEN p_brand < 'Brand#16' THEN 'BTC' WHEN p_brand < 'Brand#4' THEN 'USDT' ELSE 'EUR' END AS quote,
    CASE WHEN p_type = 'PROMO' THEN 'BREAK' ELSE 'TRADING' END AS status
  FROM (SELECT *, upper(split_part(p_name, ' ', 1)) AS w1, upper(split_part(p_name, ' ', 2)) AS w2 FROM part))"""
CTES["pairs"] = PAIR_SQL
CTES["live"] = "SELECT DISTINCT symbol FROM pairs WHERE p_type = 'SMALL' AND status = 'TRADING'"
CTES["quoted_candles"] = """
SELECT replace(symbol, 'Brand#', 'B') || CASE WHEN symbol < 'Brand#2' THEN 'USDT' ELSE 'BTC' END AS symbol,
  ts, open, high, low, close, volume FROM candles"""


def pairs(ws):
    ws.table("part").createOrReplaceTempView("tm_part")
    return ws.spark.sql(PAIR_SQL.replace("FROM part", "FROM tm_part").replace("VARCHAR", "STRING"))


def live(ws):
    return pairs(ws).filter("p_type = 'SMALL' and status = 'TRADING'").select("symbol").distinct()


def quoted_candles(ws):
    suffix = F.when(F.col("symbol") < "Brand#2", "USDT").otherwise("BTC")
    return ws.candles.select(
        F.concat(F.regexp_replace("symbol", "Brand#", "B"), suffix).alias("symbol"),
        "ts", "open", "high", "low", "close", "volume",
    )


# --- A: scans, sources, sinks ---------------------------------------------------------------
@query(
    "scan_candles",
    "symbol:s ts:d close:f8 low:f8 volume:f6",
    "SELECT * FROM candles WHERE ts <= DATE '2000-01-01' AND symbol IN (SELECT symbol FROM watchlist)",
)
def _(ws):
    return tables.scan_candles(ws.candles, ws.watchlist, D2000, ["symbol", "ts", "close", "low", "volume"]).orderBy("symbol", "ts")


@query("decode_kline_arrays", OHLCV, "SELECT * FROM candles")
def _(ws):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    cells = F.array(ms.cast("string"), *[F.col(c).cast("string") for c in payloads.CANDLE_FIELDS], F.lit("0"))
    return payloads.decode_kline_arrays(ws.candles.select("symbol", F.to_json(cells).alias("payload")))


@query("scan_monthly_csv", OHLCV, "SELECT * FROM candles")
def _(ws):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    stamp = F.when(F.year("ts") >= 2000, ms * 1000).otherwise(ms)
    path = _out(ws, "monthly-csv")
    rows = ws.candles.select(stamp.alias("open_time"), *payloads.CANDLE_FIELDS, "symbol")
    rows.repartition("symbol").write.partitionBy("symbol").option("header", True).csv(path)
    return payloads.scan_monthly_csv(ws.spark, path)


@query(
    "decode_market_chart",
    "symbol:s ts:d price_usd:f8 market_cap:f2 volume_24h:f2",
    "SELECT symbol, ts, close AS price_usd, run_notional AS market_cap, notional AS volume_24h FROM crn",
)
def _(ws):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    noon = ms + 43_200_000.0
    rows = ws.candles.select(
        "symbol", "ts", "open", "close", "notional", F.sum("notional").over(w).alias("cap"), ms.alias("ms"), noon.alias("noon")
    )
    chart = rows.groupBy("symbol", F.trunc("ts", "MM").alias("m")).agg(
        F.flatten(F.collect_list(F.array(F.array("noon", "close"), F.array("ms", "open"), F.array(F.col("ms") + 60000, F.lit(0.0))))).alias("prices"),
        F.collect_list(F.array("noon", "cap")).alias("market_caps"),
        F.collect_list(F.array("noon", "notional")).alias("total_volumes"),
    )
    return payloads.decode_market_chart(
        chart.select("symbol", F.to_json(F.struct("prices", "market_caps", "total_volumes")).alias("payload"))
    )


@query(
    "decode_id_list",
    "symbol:s id:s place:i",
    """SELECT symbol, id, place FROM (
      SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS place FROM (
        SELECT lower(base) AS symbol, 'id-' || p_type || '-' || p_size AS id, min(p_partkey) AS seq
        FROM (SELECT part.*, pairs.base FROM part JOIN pairs ON seq = p_partkey) GROUP BY 1, 2))""",
)
def _(ws):
    base = pairs(ws).select("seq", "base")
    part = ws.table("part").select(F.col("p_partkey").alias("seq"), F.concat_ws("-", F.lit("id"), "p_type", "p_size").alias("id"))
    listed = base.join(part, "seq").select("seq", F.to_json(F.struct("id", F.col("base").alias("symbol"))).alias("payload"))
    return payloads.decode_id_list(listed)


@query(
    "upsert_candles",
    "symbol:s ts:d close:f8",
    """SELECT symbol, ts, CASE WHEN ts >= DATE '2001-06-01' THEN close * 1.5 ELSE close END AS close FROM candles
    UNION ALL SELECT symbol, ts + 3000, close * 1.5 FROM candles WHERE ts >= DATE '2001-06-01'""",
)
def _(ws):
    stored = ws.candles.select("symbol", "ts", "close")
    late = stored.filter(F.col("ts") >= "2001-06-01").withColumn("close", F.col("close") * 1.5)
    fresh = late.unionByName(late.withColumn("ts", F.date_add("ts", 3000)))
    table = PartitionedTable(_out(ws, "candles"))
    table.create(stored)
    table.upsert(fresh)
    table.upsert(fresh)
    return table.read(ws.spark)


@query(
    "upsert_rates",
    "ts:d high:f6 low:f6 close:f6",
    "SELECT ts, CASE WHEN ts >= DATE '2001-06-01' THEN high + 1 ELSE high END AS high, low, close FROM rates",
)
def _(ws):
    fresh = ws.rates.filter(F.col("ts") >= "2001-06-01").withColumn("high", F.col("high") + 1)
    table = PartitionedTable(_out(ws, "rates"), keys=("ts",), symbol=None)
    table.create(ws.rates)
    table.upsert(fresh)
    return table.read(ws.spark)


@query(
    "upsert_market_history",
    "symbol:s ts:d price_usd:f8 market_cap:f2 volume_24h:f2 action:s",
    """WITH old AS (SELECT * FROM market_history WHERE ts < DATE '2001-01-01'),
    new AS (SELECT symbol, ts, price_usd, CASE WHEN ts >= DATE '2000-06-01' THEN market_cap + 1 ELSE market_cap END AS market_cap, volume_24h
            FROM market_history WHERE ts >= DATE '2000-01-01')
    SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.ts, o.ts) AS ts, coalesce(n.price_usd, o.price_usd) AS price_usd,
           coalesce(n.market_cap, o.market_cap) AS market_cap, coalesce(n.volume_24h, o.volume_24h) AS volume_24h,
           CASE WHEN n.symbol IS NULL THEN 'kept' WHEN o.symbol IS NULL THEN 'inserted'
                WHEN n.market_cap <> o.market_cap THEN 'updated' ELSE 'unchanged' END AS action
    FROM old o FULL JOIN new n ON o.symbol = n.symbol AND o.ts = n.ts""",
)
def _(ws):
    mh = ws.market_history
    fresh = mh.filter(F.col("ts") >= "2000-01-01").withColumn(
        "market_cap", F.when(F.col("ts") >= "2000-06-01", F.col("market_cap") + 1).otherwise(F.col("market_cap"))
    )
    table = PartitionedTable(_out(ws, "market-history"))
    table.create(mh.filter(F.col("ts") < "2001-01-01"))
    actions = materialize(table.changes(fresh), "actions")
    table.upsert(fresh)
    return table.read(ws.spark).join(actions, ["symbol", "ts"], "left").withColumn("action", F.coalesce("action", F.lit("kept")))


@query(
    "archive_snapshot",
    "symbol:s ts:d price:f8 volume:f6",
    "SELECT symbol, ts, max_by(px, k) AS price, max_by(q, k) AS volume FROM trades GROUP BY 1, 2",
)
def _(ws):
    from tidemark.sources.fixtures import trades

    quotes = trades(ws.spark, ws.sf_dir, ws.symbol).select("symbol", "ts", F.col("px").alias("price"), F.col("q").alias("volume"), "k")
    return tables.last_per_key(quotes, ["symbol", "ts"], "k")


@query(
    "dedupe_candles",
    "symbol:s ts:d price:f8",
    "SELECT symbol, ts, min_by(px, k) AS price FROM trades GROUP BY 1, 2",
)
def _(ws):
    from tidemark.sources.fixtures import trades

    rows = trades(ws.spark, ws.sf_dir, ws.symbol).select("symbol", "ts", F.col("px").alias("price"), F.col("k").alias("id"))
    return tables.first_per_key(rows, ["symbol", "ts"], "id")


CTES["claimed"] = """
SELECT symbol, listing_date - (CAST(replace(symbol, 'Brand#', '') AS INTEGER) - 20) AS listing_date FROM coins
UNION ALL SELECT 'Brand#99', DATE '1999-01-01'"""


@query(
    "ingest_plan",
    "symbol:s listing_date:d first_ts:d last_ts:d needs_backfill:b resume_from:d",
    """SELECT c.symbol, c.listing_date, f.first_ts, f.last_ts,
      f.first_ts IS NULL OR f.first_ts > c.listing_date + 2 AS needs_backfill,
      CASE WHEN NOT (f.first_ts IS NULL OR f.first_ts > c.listing_date + 2) THEN f.last_ts END AS resume_from
    FROM claimed c LEFT JOIN (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts FROM candles GROUP BY 1) f USING (symbol)""",
)
def _(ws):
    shift = F.regexp_replace("symbol", "Brand#", "").cast("int") - 20
    claimed = ws.coins.select("symbol", F.date_sub("listing_date", shift).alias("listing_date"))
    extra = claimed.limit(1).select(F.lit("Brand#99").alias("symbol"), F.lit(dt.date(1999, 1, 1)).alias("listing_date"))
    return I.ingest_plan(claimed.unionByName(extra), ws.candles)


@query(
    "demo_candles",
    "symbol:s ts:d open:f6 high:f6 low:f6 close:f6",
    """SELECT symbol, DATE '2022-01-01' + d AS ts, px AS open, px * 1.02 AS high, px * 0.97 AS low, px AS close FROM (
      SELECT symbol, CAST(d AS INTEGER) AS d, current_price * (1 + 0.35 * sin((d + i * 10) / CAST(18 AS DOUBLE)))
        * (1 - d / CAST(800 AS DOUBLE)) AS px
      FROM (SELECT symbol, current_price, row_number() OVER (ORDER BY symbol) - 1 AS i FROM coins), range(400) r(d))""",
)
def _(ws):
    return I.demo_candles(ws.coins.select("symbol", F.col("current_price").alias("base_price")), dt.date(2022, 1, 1), 400)


@query(
    "meta_summary",
    "tracked:i delisted:i last_candle:d quote_rate:f6",
    """SELECT count(*) FILTER (current_price IS NOT NULL AND delisted_at IS NULL) AS tracked,
      count(*) FILTER (delisted_at IS NOT NULL) AS delisted, (SELECT max(ts) FROM candles) AS last_candle,
      (SELECT max_by(close, ts) FROM rates) AS quote_rate FROM coins""",
)
def _(ws):
    from tidemark.operators.board import meta_summary

    return meta_summary(ws.coins, ws.candles, ws.rates)


@query(
    "sink_features_jsonl",
    "anchor:d symbol:s score:f1 price:f8 cap_current:f4 alt_above_sma:b",
    """SELECT p.anchor, p.symbol, p.score, p.price, p.cap AS cap_current, r.alt_above_sma
    FROM panel_m p JOIN regime_m r USING (anchor)""",
)
def _(ws):
    from tidemark.plans.panel import feature_rows

    path = _out(ws, "features-jsonl")
    rows = feature_rows(ws.panel(), ws.rates, ws.calendar("monthly"))
    sinks.write_features_jsonl(rows, path)
    return ws.spark.read.schema("anchor date, symbol string, score double, price double, cap_current double, alt_above_sma boolean").json(path)


@query(
    "delisted_backfill",
    "symbol:s listing_date:d is_pre_cutoff:b delisted_at:d months:i rows:i",
    """WITH recent AS (SELECT * FROM quoted_candles WHERE ts >= DATE '1997-06-01'),
    kept AS (SELECT r.symbol, r.ts FROM recent r LEFT JOIN rates USING (ts) WHERE r.symbol LIKE '%BTC' OR rates.close IS NOT NULL)
    SELECT symbol, CASE WHEN symbol < 'B15' THEN DATE '1996-01-01' ELSE first_ts END AS listing_date,
      first_ts < DATE '1998-01-01' AS is_pre_cutoff, last_ts + 1 AS delisted_at, months, n AS rows
    FROM (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM kept GROUP BY 1)
    JOIN (SELECT symbol, count(DISTINCT date_trunc('month', ts)) AS months FROM recent GROUP BY 1) USING (symbol)""",
)
def _(ws):
    known = quoted_candles(ws).filter(F.col("symbol") < "B15").select("symbol").distinct()
    known = known.withColumn("listing_date", F.lit(dt.date(1996, 1, 1)))
    return I.delisted_backfill(quoted_candles(ws), known, ws.rates, dt.date(1997, 6, 1), EVENT)[0]


@query(
    "delisted_backfill_summary",
    "coins:i months:i rows:i failed:i",
    """WITH recent AS (SELECT * FROM quoted_candles WHERE ts >= DATE '1997-06-01'),
    kept AS (SELECT r.symbol, r.ts FROM recent r LEFT JOIN rates USING (ts) WHERE r.symbol LIKE '%BTC' OR rates.close IS NOT NULL)
    SELECT count(DISTINCT symbol) AS coins, (SELECT count(DISTINCT (symbol, date_trunc('month', ts))) FROM recent) AS months,
      count(*) AS rows, 0 AS failed FROM kept""",
)
def _(ws):
    return I.delisted_backfill(quoted_candles(ws), ws.coins.filter("false"), ws.rates, dt.date(1997, 6, 1), EVENT)[1]


# --- B: filters and predicates --------------------------------------------------------------
@query(
    "split_symbol",
    "symbol:s base:s quote:s",
    """SELECT symbol, CASE WHEN symbol LIKE '%USDT' THEN left(symbol, length(symbol) - 4)
      WHEN symbol LIKE '%BTC' THEN left(symbol, length(symbol) - 3) ELSE symbol END AS base,
      CASE WHEN symbol LIKE '%USDT' THEN 'USDT' WHEN symbol LIKE '%BTC' THEN 'BTC' END AS quote
    FROM (SELECT DISTINCT symbol FROM pairs)""",
)
def _(ws):
    return I.split_symbols(pairs(ws).select("symbol").distinct())


CTES["named_pairs"] = """
SELECT DISTINCT symbol, base, CASE WHEN p_type = 'LARGE' THEN 'Gold ' || base WHEN p_type = 'SMALL' THEN 'Stabled ' || base
  ELSE 'Plain' END AS name, 'id-' || p_type AS market_id FROM pairs"""


def named_pairs(ws):
    name = (
        F.when(F.col("p_type") == "LARGE", F.concat(F.lit("Gold "), "base"))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("Stabled "), "base"))
        .otherwise("Plain")
    )
    return pairs(ws).select("symbol", "base", name.alias("name"), F.concat(F.lit("id-"), "p_type").alias("market_id")).distinct()


SPLIT_BASE = """CASE WHEN symbol LIKE '%USDT' THEN left(symbol, length(symbol) - 4)
      WHEN symbol LIKE '%BTC' THEN left(symbol, length(symbol) - 3) ELSE symbol END"""


@query(
    "stable_flag",
    "symbol:s market_id:s name:s is_stable:b",
    f"""SELECT symbol, market_id, name, market_id = 'id-MEDIUM' OR upper({SPLIT_BASE}) IN ({_list(S.STABLE_SYMBOLS)})
      OR upper({SPLIT_BASE}) LIKE '%USD%' OR regexp_matches(name, '(?i)\\b(usd|stables?|stablecoin|dollar|gold|euro)\\b') AS is_stable
    FROM named_pairs""",
)
def _(ws):
    ids = pairs(ws).filter("p_type = 'MEDIUM'").select(F.lit("id-MEDIUM").alias("id"))
    return I.stable_flags(named_pairs(ws), ids)


@query(
    "tracked_universe",
    "symbol:s",
    "SELECT symbol FROM coins WHERE delisted_at IS NULL AND (is_pre_cutoff OR market_cap >= 10000000)",
)
def _(ws):
    return I.tracked_universe(ws.coins)


@query(
    "preferred_pair",
    "base:s symbol:s quote:s",
    f"""SELECT base, symbol, quote FROM (
      SELECT *, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN quote = 'BTC' THEN 0 ELSE 1 END, seq) AS r
      FROM pairs WHERE status = 'TRADING' AND quote IN ('BTC', 'USDT')
        AND base NOT IN ({_list(S.STABLE_BASES + S.EXCLUDED_BASES)})) WHERE r = 1""",
)
def _(ws):
    return I.preferred_pairs(pairs(ws))


DISCOVER_SQL = f"""
WITH active_bases AS (SELECT DISTINCT {SPLIT_BASE} AS ab FROM live WHERE symbol LIKE '%USDT' OR symbol LIKE '%BTC'),
m AS (SELECT DISTINCT symbol, {SPLIT_BASE} AS base, CASE WHEN symbol LIKE '%USDT' THEN 1 ELSE 0 END AS o
      FROM pairs WHERE symbol LIKE '%USDT' OR symbol LIKE '%BTC')
SELECT base, symbol FROM (
  SELECT *, row_number() OVER (PARTITION BY base ORDER BY o, symbol) AS r FROM m
  WHERE base NOT IN ({_list(S.STABLE_BASES + S.EXCLUDED_BASES + S.FIAT_BASES)}) AND symbol NOT IN (SELECT symbol FROM live)
    AND NOT EXISTS (SELECT 1 FROM active_bases a WHERE a.ab = m.base
      OR (a.ab || 'UP') = m.base OR (a.ab || 'DOWN') = m.base OR (a.ab || 'BULL') = m.base OR (a.ab || 'BEAR') = m.base
      OR (length(a.ab) >= 3 AND contains(m.base, a.ab)))) WHERE r = 1"""


@query("discover_delisted", "base:s symbol:s", DISCOVER_SQL)
def _(ws):
    return I.discover_delisted(pairs(ws), live(ws))


@query("discover_filters", "symbol:s", f"SELECT symbol FROM ({DISCOVER_SQL})")
def _(ws):
    return I.discover_delisted(pairs(ws), live(ws)).select("symbol").orderBy("symbol")


@query(
    "new_listings",
    "symbol:s listing_date:d is_pre_cutoff:b",
    """SELECT symbol, min(ts) AS listing_date, min(ts) < DATE '1998-01-01' AS is_pre_cutoff FROM candles
    WHERE symbol NOT IN (SELECT symbol FROM watchlist) GROUP BY 1""",
)
def _(ws):
    listed = ws.coins.select("symbol").unionByName(live(ws))
    return I.new_listings(listed, ws.watchlist, ws.candles, EVENT)


# --- C: joins of the sync ---------------------------------------------------------------------
@query(
    "convert_usdt_to_btc",
    OHLCV,
    """SELECT symbol, ts, c.open / r.close AS open, c.high / r.low AS high, c.low / r.high AS low,
      c.close / r.close AS close, c.volume * c.close / r.close AS volume FROM candles c JOIN rates r USING (ts)""",
)
def _(ws):
    return I.convert_to_numeraire(ws.candles, ws.rates)


CTES["live_brands"] = "SELECT symbol FROM coins WHERE symbol <> 'Brand#9' AND symbol <> 'Brand#14'"


@query(
    "delist_archive",
    "symbol:s delisted_at:d action:s",
    """SELECT c.symbol, CASE WHEN l.symbol IS NOT NULL THEN NULL ELSE coalesce(delisted_at, DATE '2002-01-01') END AS delisted_at,
      CASE WHEN l.symbol IS NOT NULL AND delisted_at IS NOT NULL THEN 'restored'
           WHEN l.symbol IS NULL AND delisted_at IS NULL THEN 'archived' ELSE 'unchanged' END AS action
    FROM coins c LEFT JOIN live_brands l USING (symbol)""",
)
def _(ws):
    seen = ws.coins.filter("symbol not in ('Brand#9', 'Brand#14')").select("symbol")
    return I.delist_archive(ws.coins, seen, dt.date(2002, 1, 1))


CTES["id_candidates"] = """
SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY id) AS place FROM (
  SELECT DISTINCT p_brand AS symbol, 'id-' || p_type || '-' || p_brand AS id FROM part)"""
CTES["id_prices"] = """
SELECT 'id-' || p_type || '-' || p_brand AS id, avg(l_extendedprice / l_quantity) AS price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
CTES["id_caps"] = "SELECT 'id-' || p_type || '-' || p_brand AS id, sum(p_retailprice) AS cap FROM part GROUP BY 1"


def id_tables(ws):
    from pyspark.sql import Window

    part = ws.table("part")
    key = F.concat_ws("-", F.lit("id"), "p_type", "p_brand").alias("id")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("id"))
    candidates = part.select(F.col("p_brand").alias("symbol"), key).distinct().withColumn("place", place)
    line = ws.table("lineitem")
    prices = line.join(part, line.l_partkey == part.p_partkey).groupBy(key).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    caps = part.groupBy(key).agg(F.sum("p_retailprice").alias("cap"))
    return candidates, prices, caps


@query(
    "resolve_ids",
    "symbol:s id:s by_price:b candidates:i",
    """SELECT symbol, id, m AS by_price, n AS candidates FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN m THEN 0 ELSE 1 END, cap DESC, place) AS r,
        count(*) OVER (PARTITION BY symbol) AS n
      FROM (SELECT k.symbol, k.id, k.place, coalesce(c.cap, -1) AS cap,
              coalesce(abs(p.price - q.current_price) / q.current_price * 100 <= 10, FALSE) AS m
            FROM id_candidates k JOIN coins q ON q.symbol = k.symbol LEFT JOIN id_prices p ON p.id = k.id LEFT JOIN id_caps c ON c.id = k.id))
    WHERE r = 1""",
)
def _(ws):
    return I.resolve_ids(ws.coins, *id_tables(ws))


CTES["reference_prices"] = """
SELECT lower(replace(symbol, '#', '-')) AS id, avg(close) AS price FROM crn GROUP BY 1"""


@query(
    "verify_prices",
    "symbol:s deviation_pct:f2 verified:b",
    """SELECT c.symbol, round(abs(r.price - current_price) / current_price * 100, 2) AS deviation_pct,
      abs(r.price - current_price) / current_price * 100 <= 5 AS verified
    FROM coins c LEFT JOIN reference_prices r ON r.id = c.market_id WHERE market_id IS NOT NULL AND delisted_at IS NULL""",
)
def _(ws):
    ref = ws.candles.groupBy(F.lower(F.regexp_replace("symbol", "#", "-")).alias("id")).agg(F.avg("close").alias("price"))
    return I.verify_prices(ws.coins, ref)


@query(
    "category_flag",
    "symbol:s in_category:b",
    "SELECT symbol, coalesce(market_id LIKE 'brand-1%', FALSE) AS in_category FROM coins",
)
def _(ws):
    ids = ws.coins.filter(F.col("market_id").startswith("brand-1")).select(F.col("market_id").alias("id"))
    return I.category_flags(ws.coins, ids.unionByName(ids))


@query(
    "category_union",
    "id:s",
    "SELECT DISTINCT market_id AS id FROM coins WHERE market_id LIKE 'brand-1%' UNION SELECT DISTINCT market_id FROM coins WHERE market_id LIKE 'brand-2%'",
)
def _(ws):
    ids = ws.coins.select(F.col("market_id").alias("id"))
    return ids.filter("id like 'brand-1%'").union(ids.filter("id like 'brand-2%'")).distinct()


@query(
    "apply_metadata",
    "symbol:s name:s market_cap:f2 volume_24h:f2",
    """SELECT c.symbol, CASE WHEN m.n <> '' THEN m.n ELSE c.name END AS name,
      CASE WHEN m.id IS NOT NULL THEN m.cap ELSE c.market_cap END AS market_cap,
      CASE WHEN m.id IS NOT NULL THEN m.vol ELSE c.volume_24h END AS volume_24h
    FROM coins c LEFT JOIN (SELECT market_id AS id, CASE WHEN symbol < 'Brand#15' THEN '' ELSE upper(name) END AS n,
      market_cap * 2 AS cap, volume_24h * 3 AS vol FROM coins WHERE symbol < 'Brand#5' AND market_id IS NOT NULL) m ON m.id = c.market_id""",
)
def _(ws):
    known = ws.coins.filter((F.col("symbol") < "Brand#5") & F.col("market_id").isNotNull())
    name = F.when(F.col("symbol") < "Brand#15", "").otherwise(F.upper("name"))
    markets = known.select(
        F.col("market_id").alias("id"), name.alias("name"), (F.col("market_cap") * 2).alias("cap"), (F.col("volume_24h") * 3).alias("volume")
    )
    return I.apply_metadata(ws.coins, markets)


@query(
    "market_history_targets",
    "symbol:s market_id:s",
    "SELECT symbol, market_id FROM coins WHERE market_id IS NOT NULL",
)
def _(ws):
    return ws.coins.filter(F.col("market_id").isNotNull()).orderBy(F.coalesce("market_cap", F.lit(-1.0)).desc(), "symbol")


