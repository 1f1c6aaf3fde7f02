"""Query registry: one builder, one check SQL and one column list per key."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.calendar import Calendar, history_bounds
from tidemark.plans.panel import panel_calendar, point_in_time_panel
from tidemark.session import materialize
from tidemark.sources import fixtures as fx

EVENT = dt.date(1998, 1, 1)
UNIVERSE = 10


class Workspace:
    """The derived tables of one data folder, built on first use and kept for the session."""

    def __init__(self, spark: SparkSession, sf_dir: str, symbol: str = "brand"):
        self.spark, self.sf_dir, self.symbol = spark, sf_dir, symbol
        self._kept: dict[str, object] = {}

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table many queries read: written once to the shared folder, then scanned."""
        if name not in self._kept:
            self._kept[name] = materialize(build(), name)
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    @property
    def candles(self) -> DataFrame:
        return self.keep("candles", lambda: fx.candles(self.spark, self.sf_dir, self.symbol))

    @property
    def rates(self) -> DataFrame:
        return self.keep("rates", lambda: fx.rates(self.spark, self.sf_dir))

    @property
    def market_history(self) -> DataFrame:
        return self.keep("market_history", lambda: fx.market_history(self.candles))

    @property
    def coins(self) -> DataFrame:
        return self.keep("coins", lambda: fx.coins(self.candles))

    @property
    def watchlist(self) -> DataFrame:
        return fx.watchlist(self.coins)

    @property
    def bounds(self) -> tuple[dt.date, dt.date]:
        if "bounds" not in self._kept:
            self._kept["bounds"] = history_bounds(self.candles)
        return self._kept["bounds"]

    @property
    def last_day(self) -> dt.date:
        return self.bounds[1]

    def calendar(self, frequency: str) -> Calendar:
        name = f"calendar_{frequency}"
        if name not in self._kept:
            self._kept[name] = panel_calendar(self.candles, frequency)
        return self._kept[name]

    def panel(self, frequency: str = "monthly") -> DataFrame:
        return self.keep(
            f"panel_{frequency}",
            lambda: point_in_time_panel(
                self.candles, self.market_history, self.coins, self.calendar(frequency), EVENT
            ),
        )


_WORKSPACES: dict[tuple, Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str, symbol: str = "brand") -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir, symbol)
    if key not in _WORKSPACES:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # days are UTC days throughout
        _WORKSPACES[key] = Workspace(spark, sf_dir, symbol)
    return _WORKSPACES[key]


@dataclass(frozen=True)
class Query:
    key: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Workspace], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(workspace(spark, sf_dir))
        return df.select(*[_spark_cast(F.col(f"`{n}`"), t).alias(n) for n, t in self.columns])


REGISTRY: dict[str, Query] = {}


def query(key: str, columns: str, sql: str | None = None):
    """Register a builder. ``columns`` is 'name:type ...' with s, d, i, b, fN (N decimals)
    or lN (signed log scale, N decimals, for compounded values of any magnitude)."""
    parsed = tuple(tuple(c.split(":")) for c in columns.split())

    def register(build):
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(key, parsed, build, sql)
        return build

    return register


def _spark_cast(col: Column, kind: str) -> Column:
    if kind in ("s", "d"):
        return col.cast("string")
    if kind in ("i", "b"):
        return col.cast("bigint")
    unit = F.lit(float(10 ** int(kind[1:])))
    value = col.cast("double")
    if kind[0] == "l":
        value = F.signum(value) * F.log1p(F.abs(value))
    rounded = F.rint(value * unit) / unit
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def _sql_cast(name: str, kind: str) -> str:
    if kind in ("s", "d"):
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    if kind in ("i", "b"):
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    unit = f"CAST({10 ** int(kind[1:])} AS DOUBLE)"
    value = f'CAST("{name}" AS DOUBLE)'
    if kind[0] == "l":
        value = f"sign({value}) * ln(1 + abs({value}))"
    r = f"round_even({value} * {unit}, 0) / {unit}"
    return f'CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS "{name}"'


def full_sql(q: Query, ctes: dict[str, str]) -> str:
    """The check statement with exactly the common table expressions it needs."""
    names = sorted(ctes, key=len, reverse=True)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b")
    needed: set[str] = set()
    todo = [q.sql]
    while todo:
        for name in set(pattern.findall(todo.pop())):
            if name not in needed:
                needed.add(name)
                todo.append(ctes[name])
    parts = [f"{n} AS MATERIALIZED ({ctes[n].strip()})" for n in ctes if n in needed]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return f"{head}SELECT {', '.join(_sql_cast(n, t) for n, t in q.columns)}\nFROM ({q.sql.strip()}) AS result"
