"""Stored series that change: copy-on-write of touched partitions, and a change log with compaction.

A table is a folder partitioned by (year, bucket of the symbol). An upsert reads and rewrites only the partitions that
hold an incoming key, so its work grows with what comes in, not with what is stored; all other files stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize
from tidemark.sources.tables import change_actions, last_per_key

YEAR, BUCKET, VERSION = "__year", "__bucket", "__version"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and len(files.listStatus(where)) > 0


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class PartitionedTable:
    """A keyed table under `path`. `ts` is the date column of the key, `symbol` the column dealt to `buckets`, None if the
    table has one row per day. Rows without a day or symbol have a partition of their own."""

    path: str
    keys: tuple[str, ...] = ("symbol", "ts")
    ts: str = "ts"
    symbol: str | None = "symbol"
    buckets: int = 16

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(self.symbol), F.lit(self.buckets)).cast("int") if self.symbol else F.lit(0)
        return rows.withColumns({YEAR: F.coalesce(F.year(self.ts), F.lit(0)), BUCKET: bucket})

    def _write(self, placed: DataFrame) -> None:
        writer = placed.sortWithinPartitions(YEAR, BUCKET, *self.keys).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(YEAR, BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Write `rows`, one per key, as the first content."""
        self._write(self._placed(rows).repartition(YEAR, BUCKET))

    def _rows(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark).drop(YEAR, BUCKET)

    def touched(self, placed: DataFrame) -> Column | None:
        """Partition filter of the incoming keys; None without any. What reaches the driver is at most years x buckets."""
        found: dict[int, list[int]] = {}
        for row in placed.select(YEAR, BUCKET).distinct().collect():
            found.setdefault(row[YEAR], []).append(row[BUCKET])
        parts = None
        for year, buckets in sorted(found.items()):
            part = (F.col(YEAR) == year) & F.col(BUCKET).isin(sorted(buckets))
            parts = part if parts is None else parts | part
        return parts

    def upsert(self, incoming: DataFrame, order: str | None = None) -> None:
        """Insert or overwrite on the key, in touched partitions only; a repeat changes nothing.

        `incoming` has one row per key, or the row with the largest `order` (a column of the table) wins, among stored rows
        as well. It is written first, as it may come from the table itself. Old and new rows of a partition meet in one
        shuffle, and the partition's files are replaced when the job commits: readers and failed jobs see the old ones.
        """
        spark = incoming.sparkSession
        if not _exists(spark, self.path):
            self.create(last_per_key(incoming, self.keys, order).select(*incoming.columns) if order else incoming)
            return
        stored = self._rows(spark)
        columns = [c for c in stored.columns if c not in (YEAR, BUCKET)]
        placed = materialize(self._placed(incoming.select(*columns)), "incoming")
        parts = self.touched(placed)
        if parts is None:
            return
        old = stored.filter(parts).select(*columns, YEAR, BUCKET)
        place = [YEAR, BUCKET, *self.keys]
        if order:
            both = old.unionByName(placed).repartition(YEAR, BUCKET)
            merged = last_per_key(both, place, order)
        else:
            both = old.withColumn("__arrival", F.lit(0)).unionByName(placed.withColumn("__arrival", F.lit(1)))
            merged = last_per_key(both.repartition(YEAR, BUCKET), place, "__arrival").drop("__arrival")
        self._write(merged.select(*columns, YEAR, BUCKET))

    def changes(self, incoming: DataFrame) -> DataFrame:
        """(key, action) of the incoming keys: inserted, updated or unchanged; reads touched partitions only."""
        spark = incoming.sparkSession
        stored = self._rows(spark)
        placed = self._placed(incoming)
        parts = self.touched(placed)
        old = (stored.filter(parts) if parts is not None else stored.limit(0)).select(*incoming.columns)
        return change_actions(old, incoming, self.keys).filter("action != 'kept'")


@dataclass(frozen=True)
class ChangeLog:
    """A table that is written as batches of changes. Each batch is appended as a folder of its own; readers take the
    row with the newest batch per key; compaction folds the batches into the base, rewriting touched partitions only.

    Rows carry the batch that wrote them, in the base too, so neither a repeated batch nor a compaction that stopped half
    way changes what is read.
    """

    path: str
    keys: tuple[str, ...] = ("symbol", "ts")
    ts: str = "ts"
    symbol: str | None = "symbol"

    @property
    def base(self) -> PartitionedTable:
        return PartitionedTable(f"{self.path}/base", self.keys, self.ts, self.symbol)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """`batch` has one row per key; writing it again replaces it."""
        batch.write.mode("overwrite").parquet(f"{self.path}/log/{VERSION}={batch_id}")

    def _log(self, spark: SparkSession) -> DataFrame | None:
        if not _exists(spark, f"{self.path}/log"):
            return None
        return spark.read.parquet(f"{self.path}/log").withColumn(VERSION, F.col(VERSION).cast("long"))

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row per key."""
        log = self._log(spark)
        if not _exists(spark, self.base.path):
            if log is None:
                raise FileNotFoundError(self.path)
            return last_per_key(log, self.keys, VERSION).drop(VERSION)
        base = self.base.read(spark)
        return (base if log is None else last_per_key(base.unionByName(log), self.keys, VERSION)).drop(VERSION)

    def compact(self, spark: SparkSession) -> None:
        """Fold all logged batches into the base and remove them."""
        log = self._log(spark)
        if log is None:
            return
        batches = [row[VERSION] for row in log.select(VERSION).distinct().collect()]
        self.base.upsert(last_per_key(log, self.keys, VERSION).select(*log.columns), VERSION)
        for batch in batches:
            _delete(spark, f"{self.path}/log/{VERSION}={batch}")

    def sink(self, every: int = 10):
        """foreachBatch writer: appends each batch and compacts after every `every` of them."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
            if (batch_id + 1) % every == 0:
                self.compact(batch.sparkSession)

        return write

