"""Touched partitions, change log and compaction."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tidemark.sources.store import ChangeLog, PartitionedTable

D = dt.date
SCHEMA = "symbol string, ts date, v double"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((r.symbol or "", str(r.ts), r.v) for r in df.select("symbol", "ts", "v").collect())


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    table = PartitionedTable(str(tmp_path / "t"), buckets=4)
    stored = [(f"s{k}", D(2019 + y, 5, 1 + m), float(k)) for k in range(12) for y in range(3) for m in range(3)]
    table.create(spark.createDataFrame(stored, SCHEMA))
    before = files(table.path)
    fresh = [("s1", D(2021, 5, 1), -1.0), ("s1", D(2021, 6, 1), -2.0), ("new", D(2030, 1, 1), -3.0), (None, D(2021, 1, 1), 7.0)]
    incoming = spark.createDataFrame(fresh, SCHEMA)
    assert {(r.symbol, r.ts): r.action for r in table.changes(incoming).collect()} == {
        ("s1", D(2021, 5, 1)): "updated", ("s1", D(2021, 6, 1)): "inserted", ("new", D(2030, 1, 1)): "inserted", (None, D(2021, 1, 1)): "inserted",
    }
    table.upsert(incoming)
    after = files(table.path)
    want = {(s, t): v for s, t, v in stored} | {(s, t): v for s, t, v in fresh}
    assert rows(table.read(spark)) == sorted((s or "", str(t), v) for (s, t), v in want.items())
    touched = {(r["__year"], r["__bucket"]) for r in table._placed(incoming).collect()}
    gone = {f for f in before if f not in after}
    assert gone and all(any(f"__year={y}{os.sep}__bucket={b}" in f for y, b in touched) for f in gone)
    assert all(after[f] == before[f] for f in before if f not in gone) and len(gone) < len(before) / 2
    table.upsert(incoming)
    table.upsert(table.read(spark).filter("symbol = 's1'").withColumn("v", F.col("v") + 0))  # from the table itself
    assert rows(table.read(spark)) == sorted((s or "", str(t), v) for (s, t), v in want.items())
    kept = files(table.path)
    table.upsert(incoming.filter("false"))
    assert files(table.path) == kept


def test_plan_reads_touched_partitions_only(spark, tmp_path):
    table = PartitionedTable(str(tmp_path / "t"), buckets=4)
    table.create(spark.createDataFrame([(f"s{k}", D(2000 + k, 1, 1), 0.0) for k in range(20)], SCHEMA))
    placed = table._placed(spark.createDataFrame([("s3", D(2003, 1, 1), 1.0)], SCHEMA))
    assert table._rows(spark).filter(table.touched(placed)).count() == 1
    plan = table._rows(spark).filter(table.touched(placed))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_one_row_a_day_table(spark, tmp_path):
    table = PartitionedTable(str(tmp_path / "t"), keys=("ts",), symbol=None)
    table.upsert(spark.createDataFrame([("x", D(2020, 1, 1), 1.0), ("x", D(2021, 1, 1), 2.0)], SCHEMA))
    table.upsert(spark.createDataFrame([("x", D(2021, 1, 1), 5.0)], SCHEMA))
    assert rows(table.read(spark)) == [("x", "2020-01-01", 1.0), ("x", "2021-01-01", 5.0)]


def test_log_reads_and_compacts_alike(spark, tmp_path):
    rng, log, want = random.Random(1), ChangeLog(str(tmp_path / "log")), {}
    for batch in range(6):
        changes = {(f"s{rng.randrange(6)}", D(2020 + rng.randrange(3), 1, 1)): rng.random() for _ in range(8)}
        want |= changes
        log.append(spark.createDataFrame([(*k, v) for k, v in changes.items()], SCHEMA), batch)
        if batch in (2, 4):
            log.compact(spark)
            assert len(os.listdir(tmp_path / "log" / "log")) <= 1
        assert rows(log.read(spark)) == sorted((s, str(t), v) for (s, t), v in want.items())
    # A batch that is written again after later ones were folded in does not win over them.
    log.append(spark.createDataFrame([(*next(iter(changes)), -1.0)], SCHEMA), 0)
    assert -1.0 not in [r[2] for r in rows(log.read(spark))]
    log.compact(spark)
    assert -1.0 not in [r[2] for r in rows(log.read(spark))]
